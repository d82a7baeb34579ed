"""Secret scan: fixed patterns, then character Markov models that add random-looking strings.

Two order-1 character models are trained from labelled samples: ``random`` strings (keys, digests and encoded bytes) and
ordinary ``identifier`` strings (names, slugs, paths, numbers, dates, versions). Both are made by rules from the word list
below and a seeded generator, so they are the same everywhere. A candidate run is a secret where the log-likelihood ratio
of the two models is high enough; the threshold was chosen on strings of other words and seeds (see ``labelled_strings``).
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, free_name, map_rows, worker_state

#: The base kinds and their patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # AKIA[A-Z0-9]+ of 20 characters or more
HEX = re.compile(r"[0-9a-f]{24,}")  # [0-9a-f]+ of 24 characters or more
KINDS = ("assign", "access", "hex", "random")
KEYWORDS = ("passw", "secret", "token", "api")

#: A run that the models judge.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


#: Least mean log-likelihood ratio of a secret, in nats a character: twice the least tenth that no ordinary string of part 1 of
#: ``labelled_strings`` reaches (0.4), since words of other languages than English score higher.
THRESHOLD = 0.8
#: How far an ordinary string predicts itself.
REPEATS = 0.3
#: Words that ordinary identifiers are made of. Of four, one is for the choice of the threshold and one for tests.
PLAIN_WORDS = (
    "account address after agua alert amigo answer array asset aujourd beaucoup bedeutung bench block border bridge buffer bureau button calendar camino channel chart chemin child ciudad class client cluster collection complete connect contact content control copy country dashboard date default delivery derecho design device digest driver editor einheit ejemplo email enable entry entwicklung escuela event exchange fahrzeug feuille filter finish flag folder footer forward freundschaft function geschichte gesellschaft gobierno gouvernement growth header height herkunft heureux history home hour icon instance island izquierda jeunesse journal kirche label large layout lectura length list location lumiere machine maison market matrix mayor memory mercado message money month mount moyenne mujer music nachricht network niveau noche node number oiseau order output package panel parser password pattern pflicht plan point pool port posible power price private public pueblo quality quelque question quick range reader region reset response return richtung right road root sample schule script season section sender server servicio session share siempre social space stage start station stock store strasse supplier switch system tambien target team tenant test tool total toujours trabajo traffic travail tree type update user verbindung versicherung volume watch week widget window wirtschaft wissenschaft worker writer zeitung zwischen"
).split()


def words_of_part(part: int) -> list[str]:
    return [w for k, w in enumerate(PLAIN_WORDS) if (0, 0, 1, 2)[k % 4] == part]


def labelled_strings(part: int, per_class: int = 4000) -> tuple[list[str], list[str]]:
    """Random and ordinary strings, at most ``per_class`` each; parts 0 (training), 1 (choice of the threshold) and 2 (tests)
    share neither words nor seeds."""
    rnd = random.Random(1000 + part)
    alphabets = ["0123456789abcdef", ALPHABET[:26] + ALPHABET[52:62], ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62]]
    secret = []
    for _ in range(per_class):
        body = "".join(rnd.choices(rnd.choice(alphabets), k=rnd.randint(16, 48)))
        kind = rnd.randrange(8)
        secret.append(body + "=" * rnd.randint(1, 2) if kind == 0 else f"{body[:8]}-{body[8:12]}-{body[12:]}" if kind == 1 else f"{rnd.choice(('key', 'sk', 'pk', 'live', 'pat'))}_{body}" if kind == 2 else body)
    words, plain = words_of_part(part), []
    digits = lambda n: "".join(rnd.choices("0123456789", k=n))
    for n in range(per_class):
        parts = rnd.choices(words, k=rnd.randint(2, 6))
        date = f"20{rnd.randint(0, 39):02}-{rnd.randint(1, 12):02}-{rnd.randint(1, 28):02}"
        plain.append(
            (
                "_".join(parts), "".join(p.title() for p in parts), "-".join(parts), "".join(parts), "_".join(parts).upper(), parts[0] + "".join(p.title() for p in parts[1:]), "/".join(parts), f"{'_'.join(parts)}{rnd.randrange(100)}",
                f"{date}T{rnd.randint(0, 23):02}-{rnd.randint(0, 59):02}-{rnd.randint(0, 59):02}-{digits(3)}Z", digits(rnd.randint(16, 24)), digits(rnd.choice((1, 2))) + "0" * rnd.randint(14, 20), f"{date}/{parts[0]}/{digits(4)}", f"{parts[0]}-{digits(6)}-{digits(4)}", f"{'-'.join(parts)}-{date}", rnd.choice("-=_") * rnd.randint(16, 60), f"v{digits(1)}_{digits(2)}_{digits(1)}-{parts[0]}-{parts[1]}", f"{digits(3)}-{digits(4)}-{digits(4)}-{digits(4)}", f"{parts[0]}/{digits(4)}/{digits(2)}/{digits(2)}/{'-'.join(parts[1:])}",
            )[n % 18]
        )
    return secret, plain + regular_strings(rnd, words, per_class // 2)


#: Short parts of product, host and file names, and rows of keys.
NAME_PARTS = "b2b k8s ec2 s3 x86 h264 mp4 utf8 i18n aws gcp saas sdk api v2 ipv6 sha2 web3 mp3 t5 a11y e2e db2 c3 r2 p2p us1 eu2 srv01 node12 cpu4 gpu8 rev3 b12 q4 fy24 xl pro max mini usb3 hdmi2".split()
KEY_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "azertyuiop", "1234567890", "0123456789", "abcdefghijklmnopqrstuvwxyz")


def regular_strings(rnd: random.Random, words: list[str], n: int) -> list[str]:
    """Ordinary strings without words, or with drawn-out ones: one character over and over, short units repeated, alphabets and rows of keys,
    sequence data, and names of products, hosts and files."""
    any_of = lambda s, low, high: "".join(rnd.choices(s, k=rnd.randint(low, high)))
    digits = lambda k: any_of("0123456789", k, k)
    out = []
    for k in range(n):
        row = rnd.choice(KEY_ROWS)
        if rnd.random() < 0.5:
            row = row[::-1] if rnd.random() < 0.3 else row.upper()
        word = rnd.choice(words)
        at = rnd.randrange(len(word))
        out.append(
            (
                rnd.choice(ALPHABET) * rnd.randint(16, 60), any_of(ALPHABET, 2, 5) * 30, (row * 6)[rnd.randrange(5) :], any_of("ACGT", 16, 60), any_of(rnd.choice(("acgt", "ACGU", "01", "XO", "GATC")), 16, 60),
                "-".join(rnd.choices(NAME_PARTS, k=rnd.randint(5, 9))), "-".join(x for pair in zip(rnd.choices(NAME_PARTS, k=3), rnd.choices(words, k=3), strict=True) for x in pair), word[:at] + word[at] * rnd.randint(12, 30) + word[at:],
                f"{rnd.choice(('IMG', 'DSC', 'VID', 'PXL', 'Screenshot', 'scan', 'WA'))}_20{digits(2)}{rnd.randint(1, 12):02}{rnd.randint(1, 28):02}_{digits(6)}", "".join(w[: rnd.randint(2, 5)].title() for w in rnd.choices(words, k=6)), f"{word}_{rnd.choice(words)}_{digits(4)}-{digits(2)}_v{digits(1)}_final", "".join(x * rnd.randint(1, 4) for x in word) * 3,
            )[k % 12][:60]
        )
    return [s for s in out if len(s) >= 16]


def training_samples(per_class: int = 4000) -> tuple[list[str], list[str]]:
    """Labelled samples of the fit, at most ``per_class`` of each class: random strings and ordinary ones."""
    return labelled_strings(0, per_class)


class MarkovModel:
    """Order-1 model over the run alphabet with additive smoothing; ``score`` is a mean log-probability per character."""

    def __init__(self, samples: list[str], smoothing: float = 0.5):
        size = len(ALPHABET)
        count = {a: dict.fromkeys(ALPHABET, smoothing) for a in ["", *ALPHABET]}
        for s in samples:
            for a, b in zip(["", *s], s, strict=False):
                count[a][b] += 1
        self.log = {a + b: math.log(c / total) for a, row in count.items() for total in [sum(row.values())] for b, c in row.items()}
        assert len(self.log) == size * (size + 1)

    def total(self, text: str) -> float:
        log = self.log
        return log[text[0]] + sum(log[text[i : i + 2]] for i in range(len(text) - 1))


class SecretScanner:
    """Spans ``(start, kind, end)`` of a text. ``threshold`` is the least mean log-likelihood ratio (nats a character)."""

    def __init__(self, samples: tuple[list[str], list[str]] | None = None, threshold: float = THRESHOLD):
        secret, plain = samples or training_samples()
        self.secret, self.plain, self.threshold = MarkovModel(secret), MarkovModel(plain), threshold
        self.likely = {pair: math.exp(log) for pair, log in self.plain.log.items()}

    def likelihood_ratio(self, run: str) -> float:
        """Mean log-likelihood ratio of a run: above 0 it is rather random than ordinary. Ordinary strings may repeat themselves: where a character came
        before in the run, REPEATS of its next one's probability is what followed it there."""
        total = self.secret.log[run[0]] - self.plain.log[run[0]]
        follows: Counter = Counter()
        for pair in map("".join, zip(run, run[1:], strict=False)):
            a = pair[0]
            likely = self.likely[pair] if not follows[a] else (1 - REPEATS) * self.likely[pair] + REPEATS * follows[pair] / follows[a]
            total += self.secret.log[pair] - math.log(likely)
            follows[pair] += 1
            follows[a] += 1
        return total / len(run)

    def base(self, text: str) -> list[tuple[int, int, int]]:
        found = []
        lower = text.lower()
        if any(k in lower for k in KEYWORDS):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return sorted(found)

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Runs that touch no base span and that the models call random."""
        found, at, reach, base = [], 0, -1, sorted(base)
        for m in RUN.finditer(text):
            while at < len(base) and base[at][0] < m.end():
                reach = max(reach, base[at][2])
                at += 1
            if reach <= m.start() and self.likelihood_ratio(m.group()) >= self.threshold:
                found.append((m.start(), 3, m.end()))
        return found

    def scan(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        base = self.base(text)
        return base, sorted(base + self.added(text, base))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by ``mark``."""
    parts, at = [], 0
    for start, _, end in spans:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join(parts) + text[at:] if parts else text


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, with_text: bool = False) -> DataFrame:
    """Per row of ``docs``: the id, the base spans and all spans as ``kind:start:end`` lists (code points, end exclusive,
    by start and then kind), counts by kind, and with ``with_text`` the text with secrets replaced.

    Null and empty texts have no spans; a null text stays null in ``redacted``; a null id stays null; repeated rows are
    scanned each; an empty table gives no rows; further columns are ignored. Runs of any length are judged whole.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batch):
        scanner = worker_state(("secrets", threshold), lambda: SecretScanner(threshold=threshold))
        raw = batch.column(1).to_pylist()
        both = [scanner.scan(t or "") for t in raw]
        out = {"id": batch.column(0), "base_spans": [written(b) for b, _ in both], "spans": [written(a) for _, a in both]}
        for kind, name in enumerate(KINDS):
            out[f"n_{name}"] = [sum(s[1] == kind for s in a) for _, a in both]
        if with_text:
            out["redacted"] = [t if t is None else redacted(t, a) for t, (_, a) in zip(raw, both, strict=True)]
        return out

    schema = f"id {id_type}, base_spans string, spans string, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", redacted string" * with_text
    out = map_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), scan, schema)
    return out.withColumnRenamed("id", id_col)


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with secrets in the text replaced; ``length_col``, if there is one, is counted anew for changed
    texts. All rows stay, repeated ones and those without an id too; null texts stay null; other columns stay as they are,
    whatever their names; an empty table stays empty."""

    name = free_name(docs, "redacted")

    def scan(batch):
        scanner = worker_state(("secrets", threshold), lambda: SecretScanner(threshold=threshold))
        return {name: [t and redacted(t, scanner.scan(t)[1]) for t in batch.column(0).to_pylist()]}

    made = add_columns(docs, [F.col(f"`{text_col}`")], scan, f"{name} string")
    changed = ~F.col(f"`{text_col}`").eqNullSafe(F.col(name))
    new = {text_col: F.col(name)}
    if length_col in docs.columns:
        new[length_col] = F.when(changed, F.length(name).cast(docs.schema[length_col].dataType)).otherwise(F.col(f"`{length_col}`"))
    return made.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))

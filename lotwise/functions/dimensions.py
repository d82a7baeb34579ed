"""Small fixed tables of the domain: codes, labels and groups. They must be those that pages and requests use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Property type codes and labels of each group, in order.
TYPES = {
    "N": {"CONDO": "Condominium", "APT": "Apartment", "WALK": "Walk-up", "CLUS": "Cluster house", "EXCON": "Executive condominium"},
    "H": {
        "1R": "1 room", "2A": "2A", "2I": "2I", "2S": "2S", "2RF": "2 room flexi", "3A": "3A", "3NG": "3NG", "3Am": "3A modified", "3NGm": "3NG modified", "3I": "3I", "3Im": "3I modified", "3S": "3S", "3STD": "3 standard", "3PA": "3PA",
        "4A": "4A", "4NG": "4NG", "4PA": "4PA", "4I": "4I", "4S": "4S", "4STD": "4 standard", "5A": "5A", "5I": "5I", "5PA": "5PA", "5S": "5S", "6J": "Jumbo", "EA": "Executive apartment", "EM": "Executive maisonette", "MG": "Multi generation", "TE": "Terrace",
    },
    "L": {"TERRA": "Terraced house", "CORN": "Corner terrace", "SEMI": "Semi-detached house", "DETAC": "Detached house", "BUNG": "Bungalow", "LBUNG": "Good class bungalow", "TOWN": "Town house", "CON": "Conservation house", "LCLUS": "Cluster house", "SHOPH": "Shophouse", "RLAND": "Land only"},
}
LAND_ONLY = "RLAND"
GROUP_LABELS = {"N": "Condo", "H": "HDB", "L": "Landed"}
BEDROOMS = {"0": "Studio", "1": "1", "2": "2", "3": "3", "4": "4", "5": "5+"}
BATHROOMS = {"1": "1", "2": "2", "3": "3", "4": "4", "5": "5+"}
TENURES = {"F": "Freehold", "L99": "99-year", "L103": "103-year", "L110": "110-year", "L999": "999-year", "L9999": "9999-year", "NA": "Unknown"}
FLOOR_LEVELS = {"GND": "Ground", "LOW": "Low", "MID": "Mid", "HIGH": "High", "PENT": "Penthouse"}
FURNISHINGS = {"UNFUR": "Unfurnished", "PART": "Partially furnished", "FULL": "Fully furnished"}
UNIT_FEATURES = {"AIRC": "Aircon", "BAL": "Balcony", "BATH": "Bath tub", "CORN": "Corner unit", "MAID": "Helper’s room", "PPOOL": "Private pool", "RENO": "Renovated", "TERR": "Terrace"}
PROJECT_FEATURES = {"GYM": "Gym", "PARK": "Parking", "SWIM": "Swimming pool", "TEN": "Tennis court"}
LISTING_FEATURES = {"isVerified": "Verified listings", "withFloorplans": "With floor plan", "withStream": "With video or virtual tour"}
DISTANCES = {"0.25": "Under 250 m", "0.5": "Under 500 m", "0.75": "Under 750 m", "1": "Under 1 km", "1.5": "Under 1.5 km"}
POSTED = {"3": "Within 3 days", "7": "Within 1 week", "14": "Within 2 weeks", "31": "Within 1 month"}
DISTRICTS = (
    "Boat Quay / Raffles Place / Marina", "Chinatown / Tanjong Pagar", "Alexandra / Commonwealth", "Harbourfront / Telok Blangah", "Buona Vista / West Coast / Clementi New Town", "City Hall / Clarke Quay", "Beach Road / Bugis / Rochor", "Farrer Park / Serangoon Rd",
    "Orchard / River Valley", "Tanglin / Holland / Bukit Timah", "Newton / Novena", "Balestier / Toa Payoh", "Macpherson / Potong Pasir", "Eunos / Geylang / Paya Lebar", "East Coast / Marine Parade", "Bedok / Upper East Coast", "Changi Airport / Changi Village", "Pasir Ris / Tampines",
    "Hougang / Punggol / Sengkang", "Ang Mo Kio / Bishan / Thomson", "Clementi Park / Upper Bukit Timah", "Boon Lay / Jurong / Tuas", "Dairy Farm / Bukit Panjang / Choa Chu Kang", "Lim Chu Kang / Tengah", "Admiralty / Woodlands", "Mandai / Upper Thomson", "Sembawang / Yishun", "Seletar / Yio Chu Kang",
)
#: Regions and the numbers of their districts.
REGIONS = {"City & South West": range(1, 9), "Orchard / Holland": (9, 10), "Newton / Bt. Timah": (11, 21), "Balestier / Geylang": (12, 13, 14), "East Coast": (15, 16), "Changi / Pasir Ris": (17, 18), "Serangoon / Thomson": (19, 20), "West": (22, 23, 24), "North": (25, 26, 27, 28)}


def district_code(number: int) -> str:
    return f"D{number:02}"


def districts(spark: SparkSession) -> DataFrame:
    """Code, name and region of each district: the code is the place in the list."""
    region = {n: r for r, numbers in REGIONS.items() for n in numbers}
    return spark.createDataFrame([(district_code(n), name, region[n]) for n, name in enumerate(DISTRICTS, 1)], "code string, name string, region string")


def property_types(spark: SparkSession) -> DataFrame:
    """Group, code, label and place of each property type."""
    return spark.createDataFrame([(g, c, label, k) for g, of in TYPES.items() for k, (c, label) in enumerate(of.items())], "grp string, code string, label string, place int")


def _lookup(pairs: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair)), key)


def label_of(options: dict[str, str], code: Column) -> Column:
    """A code's label; a code without one stays."""
    return F.coalesce(_lookup(options, code), code)


def labels_of(options: dict[str, str], codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c: label_of(options, c)), ", ")


ALL_TYPES = {c: label for of in TYPES.values() for c, label in of.items()}
GROUP_OF_TYPE = {c: g for g, of in TYPES.items() for c in of}
#: Two groups have a "Cluster house": the later one counts.
CODE_OF_LABEL = {label.lower(): c for c, label in ALL_TYPES.items()}
DISTRICT_LABELS = {district_code(n): f"{district_code(n)} {name}" for n, name in enumerate(DISTRICTS, 1)}


def type_code(text: Column) -> Column:
    """The code that a stated type is, or whose label it is in any case; null for others."""
    plain = F.trim(text)
    return F.when(plain.isin(*GROUP_OF_TYPE), plain).otherwise(_lookup(CODE_OF_LABEL, F.lower(plain)))


def group_of(stated: Column, property_type: Column) -> Column:
    """The stated group if there is such a one, else that of the property's type, else the first."""
    return F.coalesce(F.when(stated.isin(*TYPES), stated), _lookup(GROUP_OF_TYPE, type_code(property_type)), F.lit("N"))

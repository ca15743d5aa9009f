"""Fixed values of the domain: programs, calendar, regions, title rules, source priorities.

Everything here is data. The frames built from it are literal relations, so Spark
knows their size and joins to them never shuffle the large side.
"""

from __future__ import annotations

from typing import NamedTuple


class Program(NamedTuple):
    exam_code: str
    name: str
    level: str | None
    slug: str
    category: str
    keywords: tuple[str, ...]
    site_slug: str


# The program registry, in display order.
PROGRAMS: tuple[Program, ...] = (
    Program("LET-E", "Licensure Examination for Teachers (Elementary)", "Elementary", "let-elementary",
            "education", ("LET elementary", "teachers elementary", "BLEPT elementary"), "let-elementary"),
    Program("LET-S", "Licensure Examination for Teachers (Secondary)", "Secondary", "let-secondary",
            "education", ("LET secondary", "teachers secondary", "BLEPT secondary"), "let-secondary"),
    Program("CPALE", "Certified Public Accountant Licensure Examination", None, "cpale",
            "business", ("CPALE", "CPA board", "certified public accountant"), "cpa"),
    Program("NLE", "Nurse Licensure Examination", None, "nursing",
            "health", ("NLE", "nurse licensure", "nursing board"), "nle"),
    Program("CLE", "Criminologists Licensure Examination", None, "criminology",
            "social", ("criminology board", "criminologist licensure", "CLE"), "criminology"),
    Program("CELE", "Civil Engineers Licensure Examination", None, "civil-engineering",
            "engineering", ("civil engineering board", "civil engineer licensure", "CELE"), "cele"),
    Program("ECE", "Electronics Engineers Licensure Examination", None, "electronics-engineering",
            "engineering", ("electronics engineering board", "ECE board", "electronics engineer"), "ece"),
    Program("REE", "Registered Electrical Engineers Licensure Examination", None, "electrical-engineering",
            "engineering", ("electrical engineering board", "REE board", "electrical engineer"), "ree"),
    Program("MELE", "Mechanical Engineers Licensure Examination", None, "mechanical-engineering",
            "engineering", ("mechanical engineering board", "mechanical engineer licensure", "MELE"), "mele"),
    Program("PLE", "Physician Licensure Examination", None, "medicine",
            "health", ("physician licensure", "medical board", "PLE"), "ple"),
    Program("MTLE", "Medical Technologists Licensure Examination", None, "medical-technology",
            "health", ("medical technology board", "medtech licensure", "MTLE"), "mtle"),
    Program("ALE", "Architects Licensure Examination", None, "architecture",
            "architecture", ("architecture board", "architect licensure", "ALE"), "ale"),
    Program("PhLE", "Pharmacist Licensure Examination", None, "pharmacy",
            "health", ("pharmacy board", "pharmacist licensure", "PhLE"), "phle"),
    Program("PSY", "Psychologist / Psychometrician Licensure Examination", None, "psychology",
            "health", ("psychometrician licensure", "psychologist licensure", "psychology board"), "psychology"),
    Program("AgriLE", "Agriculturist Licensure Examination", None, "agriculture",
            "agriculture", ("agriculturist licensure", "agriculture board", "agriculturist"), "agriculture"),
)

# Category display order.
CATEGORY_ORDER = ("education", "health", "engineering", "architecture", "business", "social", "agriculture")

# Expected months per program.
CALENDAR: dict[str, tuple[str, ...]] = {
    "CPALE": ("May", "October"),
    "NLE": ("June", "December"),
    "CLE": ("June", "November"),
    "CELE": ("March", "November"),
    "ECE": ("April", "October"),
    "REE": ("April", "October"),
    "MELE": ("April", "October"),
    "PLE": ("June", "December"),
    "MTLE": ("January", "March", "February", "August", "September"),
    "ALE": ("June", "December"),
    "PhLE": ("August",),
    "PSY": ("April", "October"),
    "AgriLE": ("June", "December"),
    "LET-E": ("March", "September"),
    "LET-S": ("March", "September"),
}
DEFAULT_MONTHS = ("March", "June", "September", "December")

# Calendar months in order.
MONTHS = ("January", "February", "March", "April", "May", "June",
          "July", "August", "September", "October", "November", "December")

# Short month spellings.
MONTH_ALIASES = {"jan": "January", "feb": "February", "mar": "March", "apr": "April", "may": "May",
                 "jun": "June", "jul": "July", "aug": "August", "sep": "September", "sept": "September",
                 "oct": "October", "nov": "November", "dec": "December"}

# Source tags and their precedence, strongest first.
SOURCE_PRIORITY = (
    ("manual://user-csv-national", 5),
    ("manual://user-csv-schools", 5),
    ("prc.gov.ph", 3),
    ("prcboard.com", 2),
    ("prcboard.com/direct", 1),
)
NATIONAL_CSV_TAG = "manual://user-csv-national"
SCHOOL_CSV_TAG = "manual://user-csv-schools"
OFFICIAL = "prc.gov.ph"
MIRROR = "prcboard"
OFFICIAL_SITE = "https://www.prc.gov.ph"
MIRROR_SITE = "https://www.prcboard.com"

# Words of exam names that identify no program.
GENERIC_NAME_WORDS = ("registered", "engineers", "engineer", "licensure", "examination", "examinations",
                      "board", "professional", "results", "passers", "list")
NAME_STOP_WORDS = ("for", "the", "and", "/")

# Title words a program requires or refuses: code -> (require any, exclude any).
TITLE_RULES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "LET-E": (("elementary", "let-e", "let elementary", "blept elementary"), ()),
    "LET-S": (("secondary", "let-s", "let secondary", "blept secondary"), ()),
    "PSY": (("psychometrician", "psychologist", "psychology"), ()),
    "PLE": ((), ("master plumber", "mple", "master-plumber")),
    "AgriLE": (("agriculturist", "agriculture", "agri"), ()),
    "ALE": (("architect", "architecture"), ("agriculturist", "agriculture")),
    "ECE": (("electronics", "electronics engineer", "ece"),
            ("physical therapist", "ptle", "pharmacist", "phle")),
    "PhLE": (("pharmacist", "pharmacy", "phle"), ("physical therapist", "ptle", "electronics")),
    "CELE": (("civil engineer", "civil engineering", "cele"),
             ("criminolog", "electrical engineer", "electronics")),
}

# Regions (name, code).
REGIONS = (
    ("National Capital Region", "NCR"),
    ("Cordillera Administrative Region", "CAR"),
    ("Ilocos Region", "Region I"),
    ("Cagayan Valley", "Region II"),
    ("Central Luzon", "Region III"),
    ("CALABARZON", "Region IV-A"),
    ("MIMAROPA", "Region IV-B"),
    ("Bicol Region", "Region V"),
    ("Western Visayas", "Region VI"),
    ("Central Visayas", "Region VII"),
    ("Eastern Visayas", "Region VIII"),
    ("Zamboanga Peninsula", "Region IX"),
    ("Northern Mindanao", "Region X"),
    ("Davao Region", "Region XI"),
    ("SOCCSKSARGEN", "Region XII"),
    ("Caraga", "Region XIII"),
    ("Bangsamoro", "BARMM"),
)

# Seeded provinces (region name, province).
PROVINCES = (
    ("National Capital Region", "Metro Manila"),
    ("Central Luzon", "Pampanga"),
    ("Central Luzon", "Bulacan"),
    ("CALABARZON", "Cavite"),
    ("CALABARZON", "Laguna"),
    ("CALABARZON", "Batangas"),
    ("Central Visayas", "Cebu"),
    ("Western Visayas", "Iloilo"),
    ("Davao Region", "Davao del Sur"),
    ("Northern Mindanao", "Misamis Oriental"),
)

# School-name abbreviations, expanded in this order.
NAME_ABBREVIATIONS = (
    ("UST", "University of Santo Tomas"),
    ("UP", "University of the Philippines"),
    ("ADMU", "Ateneo de Manila University"),
    ("DLSU", "De La Salle University"),
    ("PLM", "Pamantasan ng Lungsod ng Maynila"),
    ("PLV", "Pamantasan ng Lungsod ng Valenzuela"),
    ("MSU", "Mindanao State University"),
    ("USC", "University of San Carlos"),
)

# Place words that reveal a region, in order of precedence.
REGION_HINTS = (
    ("manila", "NCR"),
    ("quezon city", "NCR"),
    ("makati", "NCR"),
    ("cebu", "Region VII"),
    ("davao", "Region XI"),
    ("baguio", "CAR"),
    ("iloilo", "Region VI"),
    ("cagayan de oro", "Region X"),
    ("pampanga", "Region III"),
)

# Search shortcuts and the words they stand for.
SEARCH_ALIASES = {
    "plv": ("pamantasan", "valenzuela"),
    "plm": ("pamantasan", "maynila"),
    "ust": ("santo", "tomas"),
    "up": ("university", "philippines"),
    "admu": ("ateneo", "manila"),
    "dlsu": ("la", "salle"),
}

# Years covered by the tracker besides the current one.
WINDOW_YEARS = 10


def name_words(program: Program, stop: tuple[str, ...]) -> list[str]:
    """Up to four words of an exam name that can identify it."""
    words = [w for w in program.name.lower().split() if w not in stop and len(w) > 3]
    return words[:4]

"""Domains, lexicons and anchors of the ledger model, as plain text."""

PRICE_ANCHORS = {
    1700: 100.0, 1710: 103.7, 1720: 101.3, 1730: 93.6, 1740: 100.0, 1750: 104.7, 1760: 115.7, 1770: 125.4, 1780: 138.3, 1790: 145.2, 1800: 203.4,
    1810: 269.0, 1820: 213.7, 1830: 175.4, 1840: 170.3, 1850: 161.2, 1860: 175.4, 1870: 193.0, 1880: 182.4, 1890: 160.0, 1900: 169.7,
}
PRICE_ANCHORS_ALT = {
    1700: 100.0, 1710: 103.0, 1720: 103.5, 1730: 96.0, 1740: 102.0, 1750: 107.0, 1760: 113.3, 1770: 120.7, 1780: 126.8, 1790: 144.0, 1800: 193.6,
    1810: 271.0, 1820: 250.5, 1830: 200.1, 1840: 212.9, 1850: 174.3, 1860: 174.3, 1870: 184.0, 1880: 177.4, 1890: 171.3, 1900: 170.3,
}
CATEGORIES = ["land_rent", "ecclesiastical", "maintenance", "salary_stipend", "administrative", "educational", "financial", "domestic", "charitable", "other"]
DIRECTIONS = ["balance_sheet", "expenditure", "income", "transfer", "unclear"]
LANGUAGES = ["english", "latin", "mixed"]
PERIODS = ["annual", "biennial", "half_year", "multi_year", "one_off", "quadrennial", "quinquennial", "sesquiannual", "triennial", "unclear"]
FALLBACK = {"direction": "unclear", "category": "other", "language": "mixed", "payment_period": "unclear"}
MODERNITY = {"annual": 1.0, "half_year": 0.9, "sesquiannual": 0.7, "one_off": 0.6, "biennial": 0.5, "triennial": 0.4, "quadrennial": 0.3, "quinquennial": 0.2, "multi_year": 0.1}
TRADITIONAL = ["ecclesiastical", "domestic"]
MODERN = ["educational", "salary_stipend"]
#: (upper bound, inclusive?, name): the first that holds; the last has no bound.
ERAS3 = [(1760, False, "pre_industrial"), (1840, True, "industrial"), (None, True, "post_industrial")]
ERAS4 = [(1780, False, "pre_industrial"), (1820, False, "transition"), (1860, False, "early_industrial"), (None, True, "late_industrial")]
ERA_SCHEMES = {
    "baseline": ERAS3,
    "alt_a": [(1750, False, "pre_industrial"), (1850, True, "industrial"), (None, True, "post_industrial")],
    "alt_b": [(1780, False, "pre_industrial"), (1840, True, "industrial"), (None, True, "post_industrial")],
    "alt_c": [(1760, False, "pre_industrial"), (1800, True, "early_industrial"), (1840, True, "late_industrial"), (None, True, "post_industrial")],
}
HEADER_EXPENDITURE = ["soluta", "stipendia"]
HEADER_INCOME = ["arrearagia", "recepta"]
PLACE_CLUSTERS = {
    "oxford_local": ["oxford", "bodleian", "clarendon", "carfax", "magdalen", "christ church", "merton", "balliol", "new college", "oriel", "pembroke", "wadham", "worcester", "hertford", "keble", "high street", "cornmarket"],
    "oxfordshire": ["wittenham", "abingdon", "banbury", "henley", "woodstock", "bicester", "wantage", "faringdon", "didcot", "thame", "chipping norton", "cuddington", "south newington", "bletchingdon"],
    "london": ["london", "fleet", "cheapside", "threadneedle", "bank", "westminster", "city", "lombard", "holborn", "strand", "chancery", "temple", "guildhall", "southwark", "lambeth"],
    "other_england": ["bristol", "birmingham", "manchester", "liverpool", "sheffield", "leeds", "cambridge", "norwich", "exeter", "york", "bath", "gloucester", "worcester", "coventry"],
}
ROLES = {
    "traditional_ecclesiastical": ["chaplain", "preacher", "minister", "curate", "rector", "vicar", "canon"],
    "domestic_service": ["cook", "janitor", "laundress", "gardener", "servant", "porter", "scout"],
    "academic_traditional": ["tutor", "fellow", "bursar", "librarian", "warden", "dean"],
    "academic_modern": ["professor", "reader", "lecturer", "demonstrator", "examiner"],
    "artisan_supplier": ["mason", "carpenter", "plumber", "glazier", "plasterer", "smith", "painter", "builder", "joiner", "thatcher", "slater", "tiler"],
    "industrial_supplier": ["ironworks", "foundry", "gas", "coal", "railway", "insurance", "bank", "printer", "stationer", "chemist", "engineer"],
    "student": ["scholar", "exhibitioner", "demy", "postmaster", "commoner"],
}
FRACTIONS = {"¼": 0.25, "½": 0.5, "¾": 0.75, "1/4": 0.25, "1/2": 0.5, "3/4": 0.75, ".25": 0.25, ".5": 0.5, ".75": 0.75}
LEDGER_STOPS = [
    "account", "accounts", "acct", "amount", "amounts", "balance", "brought", "carried", "currency", "ff", "fol", "folio", "forward", "ie", "ob", "paid", "payment", "payments",
    "pence", "penny", "per", "pound", "pounds", "received", "shilling", "shillings", "sterling", "sum", "sums", "total", "totall", "viz", "year", "years", "yr", "yrs",
]
STOP_BIGRAMS = ["and the", "as the", "at the", "by the", "for a", "for the", "from the", "have been", "in a", "in the", "is the", "of a", "of the", "on the", "that the", "the same", "this is", "to be", "to the", "was the", "which is"]
DITTO = ["ditto", "same as", "as above", "as before", "do.", "idem", "same", "as the previous", "as per"]
PERSONAL_RX = r"(?i)\bMr\.?\b|\bMrs\.?\b|\bMiss\b|\bDr\.?\b|\bRev\.?\b|\bSir\b"
TRADE_RX = r"(?i)\bmason\b|\bcarpenter\b|\bglazier\b|\bplumber\b|\bsmith\b|\bpainter\b|\bbuilder\b|\bjoiner\b|\btailor\b|\bshoemaker\b|\bblacksmith\b|\bsaddler\b"
INSTITUTION_RX = r"(?i)\bCompany\b|\bSociety\b|\bTrust\b|\bFund\b|\bBank\b|\bAssociation\b|\bInstitution\b|\bCommittee\b|\bCorporation\b|\bBrotherhood\b|\bBrothers\b"
PIPELINES = ["v2_no_gemini", "v2_no_claude", "v2_no_gpt", "v2_full"]
CALLS = {"v2_no_gemini": 2, "v2_no_claude": 2, "v2_no_gpt": 2, "v2_full": 3}

"""Canonical forms of names and addresses."""

# Word lists and maps that normalised text must agree on.
NAME_WORDS = {
    "private": "pvt", "pvt": "pvt", "limited": "ltd", "ltd": "ltd", "incorporated": "inc", "corporation": "corp", "company": "co", "centre": "center",
    "services": "service", "brothers": "bros", "enterprises": "enterprise", "industries": "industry", "technologies": "technology", "societe": "ste",
    "compagnie": "cie", "etablissements": "ets", "associates": "assoc", "and": "and", "groupe": "group", "et": "and",
}
LEGAL_SKELETONS = {"prvt": "pvt", "lmtd": "ltd", "lmtt": "ltd", "lmt": "ltd"}
ADDRESS_WORDS = {
    "street": "st", "str": "st", "saint": "st", "road": "rd", "drive": "dr", "avenue": "ave", "av": "ave", "avenu": "ave", "lane": "ln", "boulevard": "blvd",
    "bd": "blvd", "court": "ct", "place": "pl", "highway": "hwy", "parkway": "pkwy", "circle": "cir", "apartment": "apt", "suite": "ste", "floor": "fl",
    "flr": "fl", "flat": "flt", "north": "n", "south": "s", "east": "e", "west": "w", "first": "1st", "ist": "1st", "second": "2nd", "third": "3rd",
    "fourth": "4th", "chemin": "ch", "route": "rte", "impasse": "imp", "faubourg": "fbg", "sainte": "ste", "r": "rue", "bengaluru": "bangalore",
    "mysuru": "mysore", "gurugram": "gurgaon", "calcutta": "kolkata", "madras": "chennai", "bombay": "mumbai",
}
ADDRESS_DROPPED = ["no", "nos", "plot", "door", "house", "hno", "shop", "null", "cedex", "number"]
FRENCH_WORDS = {
    "allee": "all", "cours": "crs", "quai": "q", "residence": "res", "appt": "apt", "appartement": "apt", "chem": "ch", "square": "sq", "passage": "pass",
    "fg": "fbg", "lotissement": "lot", "hameau": "ham", "lieudit": "ld", "promenade": "prom", "esplanade": "esp", "carrefour": "carr", "traverse": "trav",
}
FRENCH_DROPPED = ["bis", "ter", "n", "a", "b", "c", "d", "l", "de", "la", "le", "les", "du", "des", "et", "en"]
STATES = {
    "US": {
        "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de",
        "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky",
        "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo",
        "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny",
        "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa", "rhode island": "ri",
        "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa",
        "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy", "district of columbia": "dc",
    },
    "India": {
        "andhra pradesh": "ap", "arunachal pradesh": "ar", "assam": "as", "bihar": "br", "chhattisgarh": "cg", "chattisgarh": "cg", "goa": "ga",
        "gujarat": "gj", "haryana": "hr", "himachal pradesh": "hp", "jharkhand": "jh", "karnataka": "ka", "kerala": "kl", "madhya pradesh": "mp",
        "maharashtra": "mh", "manipur": "mn", "meghalaya": "ml", "mizoram": "mz", "nagaland": "nl", "odisha": "od", "orissa": "od", "punjab": "pb",
        "rajasthan": "rj", "sikkim": "sk", "tamil nadu": "tn", "tamilnadu": "tn", "telangana": "tg", "tripura": "tr", "uttar pradesh": "up",
        "uttarakhand": "uk", "uttaranchal": "uk", "west bengal": "wb", "delhi": "dl", "jammu and kashmir": "jk", "ladakh": "la", "chandigarh": "ch",
        "puducherry": "py", "pondicherry": "py", "andaman and nicobar islands": "an", "lakshadweep": "ld", "dadra and nagar haveli": "dn",
        "daman and diu": "dd", "ts": "tg", "or": "od", "ct": "cg", "ut": "uk",
    },
    "France": {
        "hauts de france": "hdf", "nord": "hdf", "pas de calais": "hdf", "somme": "hdf", "aisne": "hdf", "oise": "hdf", "nouvelle aquitaine": "naq",
        "gironde": "naq", "landes": "naq", "pyrenees atlantiques": "naq", "dordogne": "naq", "lot et garonne": "naq", "charente": "naq",
        "charente maritime": "naq", "vienne": "naq", "deux sevres": "naq", "haute vienne": "naq", "creuse": "naq", "correze": "naq",
        "pays de la loire": "pdl", "loire atlantique": "pdl", "maine et loire": "pdl", "mayenne": "pdl", "sarthe": "pdl", "vendee": "pdl",
        "ile de france": "idf", "paris": "idf", "auvergne rhone alpes": "ara", "rhone": "ara", "provence alpes cote d azur": "paca",
        "provence alpes cote dazur": "paca", "bouches du rhone": "paca", "occitanie": "occ", "haute garonne": "occ", "grand est": "ges", "bretagne": "bre",
        "normandie": "nor", "bourgogne franche comte": "bfc", "centre val de loire": "cvl", "corse": "cor",
    },
}
GENERIC_NAME = [
    "pvt", "ltd", "llc", "llp", "lp", "inc", "corp", "co", "pc", "pllc", "plc", "the", "and", "of", "group", "service", "center", "partners", "holdings",
    "com", "smt", "dr", "mr", "mrs", "ms", "shri", "sarl", "sas", "sa", "eurl", "sasu", "sci", "snc", "ste", "cie", "et", "assoc", "public", "ets", "www",
    "de", "la", "le", "les", "du", "des", "france", "india", "usa", "ei", "eirl", "scp", "selarl", "selas", "scm", "gie", "scop", "sca", "sem", "sarlu",
]
PHONETIC = [
    ("ph", "f"), ("bh", "b"), ("dh", "d"), ("th", "t"), ("kh", "k"), ("gh", "g"), ("sh", "s"), ("ch", "c"), ("jh", "j"), ("ck", "k"), ("q", "k"),
    ("x", "ks"), ("w", "v"), ("z", "j"), ("c", "k"),
]
TOP_DOMAINS = ["com", "in", "net", "org", "co", "io", "biz", "info", "fr", "us"]

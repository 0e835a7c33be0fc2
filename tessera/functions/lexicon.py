"""Fixed values of the text functions: word lists, phrases and limits."""

from __future__ import annotations

# Fixed values, which results depend on.
STOP_WORDS = (
    "a an and are as at be but by for from has have he her his i if in into is it its of on or she so such than that the their them then there these they this to was we were what when which who will with would you your not no do does did been being can could should may might must about over under more most other also"
).split()
SUFFIXES = ("izations", "isations", "ations", "ization", "isation", "ationally", "ation", "ings", "ing", "edly", "ed", "es", "s", "ion")
PRONOUNS = ("it", "they", "them", "this", "that", "those", "these", "he", "she", "there")
ABBREVIATIONS = frozenset(
    "mr mrs ms dr prof sr jr st vs etc eg ie fig figs no vol pp ed eds al approx dept inc ltd co corp univ govt jan feb mar apr jun jul aug sep sept oct nov dec min max".split()
)
INSUFFICIENCY_PHRASES = (
    "do not contain enough information",
    "does not contain enough information",
    "do not contain sufficient information",
    "does not contain sufficient information",
    "not enough information in the provided sources",
    "not enough relevant source material",
    "the provided sources do not",
    "the sources provided do not",
    "not mentioned in the provided",
    "no information about",
    "cannot be determined from the provided",
    "unable to answer from the provided",
    "the context does not",
    "based on the provided context, there is no",
    "insufficient information",
)
TRACKING_PARAMETERS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref", "ref_src")
THIN_PATHS = (
    "/search", "/tag/", "/tags/", "/category/", "/categories/", "/index", "/archive", "/page/", "/author/", "/feed",
    "/rss", "/login", "/signup", "/cart", "/checkout", "/pricing", "/contact", "/about-us", "/privacy",
)
REFUSALS = ("i cannot", "i can't", "as an ai", "sorry", "unable to", "please provide", "i apologize", "there is no")
ACCESS_GATES = (
    ("enable javascript and cookies to continue", "the site requires JavaScript and cookies before showing content"),
    ("please sign in to continue", "the page asks visitors to sign in"),
    ("subscribe to read", "the page is behind a subscription paywall"),
    ("this content is subscriber", "the page is behind a subscription paywall"),
    ("create a free account to read", "the page asks visitors to create an account"),
    ("are you a robot", "the site is presenting a bot check"),
    ("verify you are human", "the site is presenting a bot check"),
)
FRAMEWORK_MARKS = ("__next_data__", 'id="root"', 'id="app"', "ng-app", "data-reactroot", "window.__nuxt__", "ember-application")
CJK_RANGES = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xAC00, 0xD7AF), (0x1100, 0x11FF))
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
UNACCENTED = "aaaaaaceeeeiiiinooooouuuuyy"
MARKER = r"\[(?:Source|Web)\s*\d+\]"
CJK_CLASS = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in CJK_RANGES) + "]"
STEM_SUFFIX = "^(.{4,}?)(?:" + "|".join(SUFFIXES) + ")$"

"""Fixed values of the recurring-merchant task (their order is semantic)."""

FAMILIES = ["cloud", "gym", "insurance", "mobile", "music", "software", "streaming"]
LABELS = [*FAMILIES, "none"]
# Merchant category code of each family.
MCC = {"cloud": "5732", "gym": "7997", "insurance": "6300", "mobile": "4814", "music": "5812", "software": "5734", "streaming": "5812"}
# Patterns of each family in normalised text.
PATTERNS = {
    "cloud": r"\b(cloud|storage|backup)\b|service plan",
    "gym": r"\b(gym|fitness|fit club|urban)\b",
    "insurance": r"\b(insurance|policy|cover)\b",
    "mobile": r"\b(phone|contract)\b|service bill",
    "music": r"\baudio\b|member pass",
    "software": r"\b(software|saas|productivity)\b",
    "streaming": r"\b(media|video)\b",
}
# Texts that name no family.
GENERIC = ["monthly plan", "digital service", "member plan", "subscription charge"]
# Texts of each family's merchants.
TEMPLATES = {
    "cloud": ["cloud access", "cloud backup", "storage plan", "service plan"],
    "gym": ["gym membership", "fitness monthly", "fit club", "urban gym"],
    "insurance": ["insurance monthly", "policy premium", "safe cover", "cover plan"],
    "mobile": ["phone contract", "service bill", "monthly plan", "digital plus"],
    "music": ["audio streaming", "member pass", "digital plus", "premium plan"],
    "software": ["software access", "saas billing", "productivity suite", "premium plan"],
    "streaming": ["media streaming", "video access", "digital plus", "premium plan"],
    "none": GENERIC,
}
# Words of everyday payments.
BACKGROUND = (
    r"\b(?:coffee|casual|dining|grocery|fresh|foods|neighborhood|market|electronics|marketplace|hotel|booking|ride|share|pharmacy)\b"
)
# Abbreviations in the order of their replacement (two need the blank).
ABBREVIATIONS = [("dgtl", "digital"), ("mth", "monthly"), ("prem ", "premium "), ("insur ", "insurance ")]
# Billing prefixes and marketing suffixes.
PREFIXES = ["pay", "billing", "member"]
SUFFIXES = ["online", "digital", "core", "service", "plus"]
# Corruption rates: masked text, confused MCC, background to merchant, affix.
CORRUPTION = {"valid_like": (0.30, 0.18, 0.06, 0.15), "test_like": (0.50, 0.30, 0.10, 0.25)}
# What affixes a corrupted text gets, and codes that recurring
# merchants' codes are mistaken for.
PREFIX_NOISE = ["pay ", "billing ", "member ", ""]
SUFFIX_NOISE = [" online", " core", " digital", " service", ""]
CONFUSED = {"5732": ["5734", "4814"], "5734": ["5732", "5812"], "4814": ["5734"], "5812": ["5734", "5411"], "7997": ["5812"]}
# Clock periods, amount tolerance, sentinels, cutoff.
PERIODS = [7, 14, 28, 30, 30.4375, 31, 60, 90, 365]
EPS = 0.035
MISSING = -999
NO_EVENT = 999
CUTOFF = "2026-01-01 00:00:00"
#: The test ledger ends in January 2024: its cutoff and its trailing windows.
TEST_CUTOFF = "2024-02-01 00:00:00"
TEST_WINDOWS = [7, 14, 21, 30]

"""The numbers, words and patterns that results depend on."""

# Scoring.
DEAL_SCORE_THRESHOLD = 10
MIN_OBSERVATIONS = 5
MEAN_WINDOW_DAYS = 30
STALE_AFTER_DAYS = 2
TREND_THRESHOLD_PCT_PER_DAY = 0.5
TRENDS = ("up", "down", "stable")
UNSCORED = -1

# Catalogue search and display.
PAGE_SIZE = 24
SORTS = ("deals", "price_asc", "price_desc", "discount")
DEFAULT_SORT = "deals"
MAX_SEARCH_LENGTH = 100
DEALS_SHOWN_PER_KEYWORD = 3
DEFAULT_SHOP = "amazon"
DEFAULT_CURRENCY = "EUR"
HISTORY_TABLE_ROWS = 15
HISTORY_LIMIT_DEFAULT = 30
HISTORY_LIMIT_FAVORITES = 7
HISTORY_LIMIT_RANGE = (1, 365)
MIN_CHART_POINTS = 2
MAX_DOTTED_POINTS = 20

# Crawl planning.
KNOWN_PRODUCTS_PER_KEYWORD = 150
MAX_SEARCH_PAGES = 5
SEARCH_URL = "https://www.amazon.fr/s?k="
SITE_ROOT = "https://www.amazon.fr"
PRODUCT_URL_PREFIX = "https://www.amazon.fr/dp/"
PRODUCT_HOSTS = ("amazon.fr", "www.amazon.fr")

# Identifiers and names.
MAX_ID_LENGTH = 2048
MAX_KEYWORD_LENGTH = 100

# Currency symbols.
CURRENCY_BY_SYMBOL = {"€": "EUR", "$": "USD", "£": "GBP"}

# White space as web pages use it: the characters, and as a Java regex class (whose \s covers ASCII only).
SPACES = "".join(map(chr, (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF,
)))
SPACE = r"\s\x0B\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

# Text patterns (Java regex).
PRICE_TEXT = rf"([€$£])?([0-9{SPACE}]+[,.][0-9]+)"
UNIT_PRICE_AMOUNT = rf"([0-9]+[,.][0-9]+)[{SPACE}]*€"
UNIT_PRICE_UNIT = rf"(?i)(?:/|par)[{SPACE}]*([A-Za-z0-9_{SPACE}/]+?)[{SPACE})$]"
IMAGE_SIZE_SUFFIX = r"(?i)^(https://[^/]+/images/I/[A-Za-z0-9+-]+)\..*\.(jpg|jpeg|png|gif)\z"
PRODUCT_PATH = r"(?i)/dp/([A-Z0-9]{10})"
PRODUCT_LINK = r"/dp/([A-Z0-9]{10})"
BLOCK_PAGE_FRAGMENTS = ("/errors/validateCaptcha", "/ap/signin", "/ap/cvf")

# Page selectors: element ids, classes and attributes.
TITLE_ID = "productTitle"
OFFSCREEN_CLASS = "a-offscreen"
PRICE_CLASS = "apex-pricetopay-value"
PRICE_FALLBACK_CLASS = "a-price"
CROSSED_OUT_CLASS = "srpPriceBlockAUI"
UNIT_PRICE_CLASS = "apex-priceperunit-value"
UNIT_PRICE_HINT = r"par\s+\w|/\s*\w"
UNIT_PRICE_DEPTH = 5
UNIT_PRICE_TEXT_LENGTH = 100
DELIVERY_IDS = ("delivery-message", "mir-layout-DELIVERY_BLOCK-slot-PRIMARY_DELIVERY_MESSAGE_LARGE")
THUMBNAILS_ID = "altImages"
VARIANT_IDS = ("twister", "twister-plus-inline-twister-view", "twisterContainer")
RESULT_ATTRIBUTE = ("data-component-type", "s-search-result")
RESULT_LINK_CLASS = "a-link-normal"
NEXT_PAGE_CLASS = "s-pagination-next"

# Error codes and the classes they fall in.
ERROR_CLASSES = {
    "INVALID_KEYWORD_NAME": "invalid",
    "KEYWORD_ALREADY_TRACKED": "conflict",
    "KEYWORD_NOT_FOUND": "not_found",
    "INVALID_PRODUCT_URL": "invalid",
    "PRODUCT_URL_ALREADY_TRACKED": "conflict",
    "PRODUCT_URL_NOT_FOUND": "not_found",
    "INVALID_PRODUCT_ID": "invalid",
    "INVALID_PRODUCT_QUERY": "invalid",
    "PRODUCT_NOT_FOUND": "not_found",
}
STATUS_BY_CLASS = {"invalid": 400, "not_found": 404, "conflict": 409}

# Logarithm of the size of stored sketches.
SKETCH_BITS = 12

"""Values that have to match the catalog being replaced, word for word.

Nothing here is logic: these are selector lists, word lists, limits and labels.
They are kept together, as plain text and in their natural (rank) order.
"""

# --- fixed values: selectors per field, in rank order -----------------------

LINK_SELECTORS = (
    'a[href*="/product/"]',
    ".product-item a[href]",
    ".product a[href]",
    ".woocommerce-loop-product__link[href]",
    "h2 a[href]",
    "h3 a[href]",
)

LEAN_LINK_SELECTORS = (
    'a[href*="/product/"]',
    ".woocommerce-loop-product__link[href]",
    ".product-item a[href]",
    "h2 a[href]",
)

NAME_SELECTORS = (
    "h1.entry-title",
    "h1.product_title",
    "h1.product-title",
    ".product_title",
    ".entry-title",
    "h1",
)

AREA_SELECTORS = (
    ".single-product-wrapper",
    ".product-detail",
    ".entry-summary",
    ".summary",
)

PRICE_SELECTORS = (
    ".woocommerce-Price-amount bdi",
    ".woocommerce-Price-amount",
    ".price .amount",
    ".price bdi",
    ".price",
)

SKU_SELECTORS = (".sku", ".product_meta .sku", "[data-sku]")

BRAND_SELECTORS = (".brand", ".product_meta .brand", "[data-brand]")

CATEGORY_SELECTORS = (".product_meta .posted_in a", ".breadcrumb a", ".category a")

DESCRIPTION_SELECTORS = (
    ".woocommerce-product-details__short-description",
    ".product-short-description",
    ".entry-summary p",
    ".summary p",
)

STOCK_SELECTORS = (".stock",)

IMAGE_SELECTORS = (
    ".woocommerce-product-gallery img",
    ".product-image img",
    ".wp-post-image",
    ".attachment-shop_single",
)

JSONLD_TYPE = "application/ld+json"

# --- fixed values: words ----------------------------------------------------

PRODUCT_URL_PART = "/product/"
EXCLUDED_URL_PARTS = ("add-to-cart", "filter", "page=", "orderby=", "category")
NAME_NOISE = ("BARGAIN PRICE", "Used", "NEW", "SALE")
CRUMB_NOISE = ("home", "shop")
WARRANTY_WORDS = ("warranty", "guarantee")
SHIPPING_WORDS = ("shipping", "delivery")
CURRENCY_MARKS = ("KSh", "KES")
CURRENCY_CODE = "KES"

# --- fixed values: limits ---------------------------------------------------

MIN_PAGE_TEXT = 100
MIN_NAME_LENGTH = 3
NAME_LENGTH = 200
LEAN_NAME_LENGTH = 150
MIN_DESCRIPTION_LENGTH = 20
DESCRIPTION_LENGTH = 300
EXPORT_DESCRIPTION_LENGTH = 200
CATEGORY_LEVELS = 3
IMAGES_PER_SELECTOR = 3
LEAN_PRICES_PER_SELECTOR = 2
LEAN_LINKS_PER_SELECTOR = 30
LINKS_PER_PAGE = 50
LEAN_LINKS_TOTAL = 300
LEAN_LISTING_PAGES = 25
FULL_LISTING_PAGES = 999
EMPTY_PAGES_TO_STOP = 3
PRODUCTS_PER_LISTING = 20
AREA_PRICE_ABOVE = 100.0
LEAN_PRICE_RANGE = (10.0, 10_000_000.0)
ROLLING_RESPONSES = 50
MIN_RESPONSES = 10
FAST_MEAN = 0.5
SLOW_MEAN = 2.0
TOLERATED_ERRORS = 5
LINK_BUDGET_SHARE = 0.4
REPORT_EVERY = 10
RATE_TIERS = (50.0, 20.0)
DURATION_TARGET = 60.0

# --- fixed values: labels of the summary sheet, in sheet order --------------

SUMMARY_METRICS = (
    "Total Products Scraped",
    "Products with Valid Prices",
    "Products with SKU",
    "Products with Brand Info",
    "Products with Images",
    "Average Price (KES)",
    "Highest Price (KES)",
    "Lowest Price (KES)",
    "Scraping Date",
    "Source Website",
)

FILE_PREFIX = "scraped_products"
IN_STOCK = "In Stock"
OUT_OF_STOCK = "Out of Stock"

"""Identifiers, labels and bounds the reports are defined by."""

# Application bundle ids.
APP_MAIN = "com.whizdm.moneyview.loans"
APP_IOS = "com.ios.moneyview"
APP_TOPUP = "com.whizdm.moneyview.loans.topup"

# Loan products.
NEW_PRODUCTS = ("1", "5")
REPEAT_PRODUCT = "6"

# Programme labels.
MVL_NEW = "01.MVL NEW + RETURN"
MVL_REPEAT = "02.MVL REPEAT"
DP_NEW = "03.DP NEW"
DP_REPEAT = "04.DP REPEAT"
TOPUP = "05.TOPUP"
OTHERS = "06.Others"

# Substrings of the bundle id that name a partner group, first group wins.
PARTNER_GROUPS = {
    "BlueChips": (
        "supermoney", "airtel", ".pbpa.", ".pb.", ".pb.stpl.", ".pbpq.", "tatadigital",
    ),
    "Small - IPOs": (
        "myfinflow", "fintifi", "carepal", "finlabs", "kasthi", ".fb.", "fbpa",
        "finshellpay", "sparrow", "advisor",
    ),
    "Big - IPOs": ("phonepe", "abcd", "moneycontrol"),
}
PARTNER_DEFAULT = "PennyStocks"

# Platform, from a substring of the bundle id.
IOS_MARK = ".ios"
PLATFORM_IOS = "iOS"
PLATFORM_DEFAULT = "Android"

# Loan tenure classes, in months.
MICRO_TENURE = 6
TICKET_MINI = "Mini"
TICKET_MICRO = "Micro"
TICKET_REGULAR = "Regular"

# Application tags, upper case, by repeat bucket.
LOW_AND_GROW_TAGS = (
    "PREMIUMLOWNGROWREPEAT", "REGULARLOWNGROWREPEAT", "LOW_AND_GROW_PC", "LOW_AND_GROW",
)
STARTER_TAGS = ("STARTER_REPEAT", "STARTER_RELAXED_BUREAU")
BUCKET_LOW_AND_GROW = "LowNGrow"
BUCKET_STARTER = "Starter"
BUCKET_REGULAR = "Regular"
BUCKET_OTHERS = "Others"

# Campaign label of an install without a campaign.
ORGANIC = "organic"

# Bounds.
LOOKBACK_DAYS = 150
RECENT_DAYS = 60
SLACK_HOURS = 1

"""Values that results depend on. Everything here is a fixed value, not a tuning knob."""

# Ten-year age bands, code 1 (0-9) to code 9 (80 and over).
BAND_CODES = tuple(range(1, 10))
BAND_YEARS = 10

# Five-year census labels, in code order 1..18; two of them make one ten-year band.
AGE5_LABELS = tuple(f"{5 * i} - {5 * i + 4}" for i in range(17)) + ("85+",)

# Age labels of the household head, in code order 1..10.
HEAD_LABELS = (
    "0 - 24", "25 - 29", "30 - 34", "35 - 39", "40 - 44",
    "45 - 49", "50 - 54", "55 - 59", "60 - 64", "65+",
)
# Ten-year band of each head label when a head is placed in a roster.
# The open label 65+ has no single band; it is split by HEAD_OPEN_SPLIT.
HEAD_TO_BAND = {
    "0 - 24": 3, "25 - 29": 3, "30 - 34": 4, "35 - 39": 4, "40 - 44": 5,
    "45 - 49": 5, "50 - 54": 6, "55 - 59": 6, "60 - 64": 7,
}
HEAD_OPEN_LABEL = "65+"
# Band weights for a head of 65 and over (0.194 / 2, 0.124, 0.114 as whole numbers).
HEAD_OPEN_SPLIT = {7: 97, 8: 124, 9: 114}
# Head labels rebinned for other members, and the even split of the top code.
OTHER_MEMBER_BANDS = {
    "0 - 24": 3, "25 - 29": 3, "30 - 34": 4, "35 - 39": 4, "40 - 44": 5,
    "45 - 49": 5, "50 - 54": 6, "55 - 59": 6, "60 - 64": 7, "65+": 8,
}
OTHER_TOP_SPLIT = {8: 1, 9: 1}

# Household types that have parents of the head, and those with a couple.
TYPES_WITH_PARENTS = (4, 5)
TYPES_WITH_COUPLE = (1, 2, 4, 5)

# Band weights of members whose count is known but whose age is not.
ELDER_WEIGHTS = {7: 1, 8: 2, 9: 2}

# Gaps between relatives, in bands.
SAME_BAND_PARTNER = 0.75
PARTNER_RANGE = (3, 9)
BIRTH_GAP = (3.0, 1.0)
BIRTH_GAP_MIN = 2
PARENT_GAP = (2.0, 1.0)
PARENT_GAP_RANGE = (1, 5)
PARENT_RANGE = (4, 9)

# Published-table conventions.
SUBTOTAL_LABEL = "Sub-Total"
NIL_CELL = "-"
OPEN_SIZE_LABEL = "6 and over"
OPEN_SIZE = 6
TOTAL_LABEL = "Sum"

# Fit and drift.
FIRST_BASELINE = 100.0
SIBLING_VARIANCE = 0.5

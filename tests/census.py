"""Persons by five-year age (rows) and household size 1..6 and over (columns)."""

COUNTS = {
    "0 - 4": (570, 7001, 60446, 91153, 70536, 46805),
    "5 - 9": (1031, 9763, 56383, 98412, 78951, 42372),
    "10 - 14": (269, 12630, 58623, 96151, 58909, 29005),
    "15 - 19": (1375, 24778, 86901, 130841, 61763, 27570),
    "20 - 24": (7449, 37859, 108054, 170339, 71120, 31563),
    "25 - 29": (21479, 74736, 124559, 161998, 77687, 42243),
    "30 - 34": (28556, 112741, 143561, 154871, 83305, 47635),
    "35 - 39": (27628, 97618, 137905, 155044, 95563, 50036),
    "40 - 44": (32653, 102034, 142697, 149477, 91841, 42015),
    "45 - 49": (39943, 106772, 148726, 153319, 75474, 32105),
    "50 - 54": (49717, 121805, 177394, 180292, 70463, 28639),
    "55 - 59": (50118, 125556, 181843, 166699, 57769, 24621),
    "60 - 64": (45691, 126714, 142306, 102941, 37789, 22011),
    "65 - 69": (43364, 123608, 105998, 59773, 25157, 19295),
    "70 - 74": (27015, 74986, 52046, 28407, 15190, 11226),
    "75 - 79": (29715, 71304, 43804, 23077, 15115, 10014),
    "80 - 84": (26727, 55489, 32426, 17865, 10745, 7386),
    "85+": (25715, 46286, 30795, 18673, 10508, 7216),
}
SIZE_LABELS = ("1", "2", "3", "4", "5", "6 and over")
TOTALS = (459015, 1331680, 1834467, 1959332, 1007885, 521757)
# Band shares of size 1 and of all sizes.
SIZE_1_SHARES = (0.003488, 0.003582, 0.063022, 0.122401, 0.158156, 0.217498, 0.194013, 0.123591, 0.114249)
ALL_SHARES = (0.079198, 0.082767, 0.130597, 0.159466, 0.157019, 0.173586, 0.120134, 0.056493, 0.040740)


def csv_text() -> str:
    lines = ["Household Size,Age,N"]
    for column, size in enumerate(SIZE_LABELS):
        lines += [f"{size},{age},{counts[column]}" for age, counts in COUNTS.items()]
    return "\r\n".join(lines) + "\r\n"

"""Fixed values shared by the fixture views, the cleaning patterns and the renderer.

Fixed values: the eight E2E slots with their value lists, in the order of the
cleaning table, and the fixture sentence fragment for every value.  They must equal
the dataset's values for the slot-error patterns to recognise them.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# E2E slots in MR order, as written in the MR text
# ---------------------------------------------------------------------------
MR_SLOTS = ["name", "eatType", "food", "priceRange", "customer rating", "area",
            "familyFriendly", "near"]
# internal (normalised) slot names, same order
NORM_SLOTS = ["name", "eat_type", "food", "price_range", "rating", "area",
              "family_friendly", "near"]
# divisors used by the fixture to pick a value per slot
SLOT_DIVISORS = [1, 3, 7, 11, 13, 17, 19, 23]

# Value lists per slot (order of the cleaning table)
NAMES = [
    "Alimentum", "Aromi", "Bibimbap House", "Blue Spice", "Browns Cambridge", "Clowns",
    "Cocum", "Cotto", "Fitzbillies", "Giraffe", "Green Man", "Loch Fyne",
    "Midsummer House", "Strada", "Taste of Cambridge", "The Cambridge Blue",
    "The Cricketers", "The Dumpling Tree", "The Eagle", "The Golden Curry",
    "The Golden Palace", "The Mill", "The Olive Grove", "The Phoenix", "The Plough",
    "The Punter", "The Rice Boat", "The Twenty Two", "The Vaults", "The Waterman",
    "The Wrestlers", "Travellers Rest Beefeater", "Wildwood", "Zizzi",
]
EAT_TYPES = ["coffee shop", "pub", "restaurant"]
FOODS = ["Chinese", "English", "Fast food", "French", "Indian", "Italian", "Japanese"]
PRICES = ["cheap", "less than £20", "more than £30", "high", "moderate", "£20-25"]
RATINGS = ["1 out of 5", "3 out of 5", "5 out of 5", "high", "average", "low"]
AREAS = ["city centre", "riverside"]
FAMILY = ["no", "yes"]
NEARS = [
    "All Bar One", "Avalon", "Burger King", "Café Adriatic", "Café Brazil", "Café Rouge",
    "Café Sicilia", "Clare Hall", "Crowne Plaza Hotel", "Express by Holiday Inn",
    "Rainbow Vegetarian Café", "Raja Indian Cuisine", "Ranch", "The Bakers",
    "The Portland Arms", "The Rice Boat", "The Six Bells", "The Sorrento",
    "Yippee Noodle Bar",
]
VALUES = [NAMES, EAT_TYPES, FOODS, PRICES, RATINGS, AREAS, FAMILY, NEARS]

# One fixture sentence fragment per slot value ({} = the value)
FRAGMENTS = [
    {v: f"{v} is a venue" for v in NAMES},
    {v: f"it is a {v}" for v in EAT_TYPES},
    {v: f"it offers {v} cuisine" for v in FOODS},
    {"cheap": "it is cheap", "less than £20": "it costs less than £20",
     "more than £30": "it costs more than £30", "high": "it is expensive",
     "moderate": "it is mid range priced", "£20-25": "it costs £20-25"},
    {"1 out of 5": "it is rated 1 out of 5", "3 out of 5": "it is rated 3 out of 5",
     "5 out of 5": "it is rated 5 out of 5", "high": "it has a high customer rating",
     "average": "it has an average customer rating", "low": "it has a low customer rating"},
    {"city centre": "it is in the city centre", "riverside": "it is in the riverside area"},
    {"no": "it is not family friendly", "yes": "it is family friendly"},
    {v: f"it is near {v}" for v in NEARS},
]

# slots whose values the overlap check replaces (delexicalisation)
DELEX_SLOTS = ["name", "near"]
DELEX_TOKEN = "X-delex"

"""The business rules of a well-formed ride, as plain tables.

They must equal the values by which rides are made, or the audits would flag good rows.
"""

INF = float("inf")

# First tier whose upper bound (km) is not exceeded.
DISTANCE_TIERS = [("city_short", 5.0), ("city_medium", 15.0), ("suburban", 80.0),
                  ("regional", 250.0), ("cross_country", INF)]

TRIP_CATEGORIES = [("medium", 15.0), ("long", 30.0), ("very_long", 100.0), ("ultra_long", 300.0),
                   ("extreme", 600.0), ("outlier", INF)]

# (upper bound km, lowest km/h, highest km/h), and the noise factors on top.
SPEED_TIERS = [(5.0, 15.0, 25.0), (20.0, 30.0, 45.0), (80.0, 55.0, 75.0), (INF, 80.0, 105.0)]
SPEED_NOISE = (0.85, 1.15)

ROAD_DISTANCE_FACTOR = 1.5

# ride_option_id: (least passenger share, weight per distance tier in tier order)
OPTION_RULES = {
    1: (0.0, [30, 60, 50, 0, 0]),
    2: (0.0, [30, 60, 50, 0, 0]),
    3: (1.0, [70, 60, 0, 0, 0]),
    4: (0.0, [0, 10, 30, 30, 0]),
    5: (0.5, [0, 10, 30, 30, 10]),
    6: (0.5, [0, 0, 5, 70, 90]),
}

SURGE_HOURS = [(7, 9), (17, 20)]
SURGE_RANGE = (1.2, 1.5)
TIP_RATE_RANGE = (0.05, 0.20)
DRIVER_RATING_RANGE = (3.5, 5.0)
RATING_NOISE = 1.5

COMPLETED, CANCELLED = 1, 2
NOT_CANCELLED_REASON = 1

POPULAR_PROVINCES = ["TH-10", "TH-20", "TH-83", "TH-50", "TH-90", "TH-40", "TH-77", "TH-30",
                     "TH-41", "TH-84", "TH-12"]

COUNTRY_CODE = "th"
PROVINCE_KEY = "ISO3166-2-lvl4"

# Address parts that only a place on land has.
LAND_ADDRESS_KEYS = [
    "state_district", "county", "municipality", "town", "village", "city_district", "district",
    "borough", "suburb", "subdivision", "hamlet", "croft", "isolated_dwelling", "neighbourhood",
    "allotments", "quarter", "city_block", "residential", "farm", "farmyard", "industrial",
    "commercial", "retail", "road", "house_number", "house_name", "emergency", "historic",
    "military", "natural", "landuse", "place", "railway", "man_made", "aerialway", "boundary",
    "amenity", "aeroway", "club", "craft", "leisure", "office", "mountain_pass", "shop", "tourism",
    "bridge", "tunnel", "waterway", "postcode",
]

# Shares that rides are expected to have.
EXPECTED_SHARES = {"completed": 0.80, "same_province": 0.70, "tipped": 0.20}

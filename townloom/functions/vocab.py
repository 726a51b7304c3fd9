"""Canonical vocabularies.

Fixed values: word lists, lookup tables, constants and formats that results depend on.
They are stated in natural order and must not be edited without changing results.
"""

# Program buckets.
BUCKETS = ["sport", "residential", "hotel", "retail_food_entertainment",
           "office", "parking", "open_space", "other"]
STRUCTURE_BUCKETS = ["sport", "residential", "hotel", "retail_food_entertainment",
                     "office", "parking", "open_space", "institutional", "other"]

# District types.
TYPOLOGIES = ["Entertainment", "Community", "Innovation", "Sports Park"]
TYPOLOGY_ALIASES = {"Sports Tourism": "Sports Park"}
TYPOLOGY_DRIVERS = {
    "Entertainment": ["retail_food_entertainment", "sport", "hotel"],
    "Community": ["residential", "open_space", "retail_food_entertainment"],
    "Innovation": ["office", "residential"],
    "Sports Park": ["sport", "parking", "open_space"],
}
UNSPECIFIED_TYPOLOGY = ["", "unspecified", "unknown", "none", "n/a", "na", "tbd", "null"]

# Leaf categories with an exact bucket.
PARKING_LEAVES = ["parking", "parking_garage", "parking_lot"]
RESIDENTIAL_LEAVES = ["condominium", "apartment", "housing_authority",
                      "residential_building", "service_apartment"]
HOTEL_LEAVES = ["hotel", "motel", "inn", "lodge", "resort", "lodging", "bed_and_breakfast"]
SPORT_LEAVES = [
    "stadium_arena", "baseball_stadium", "hockey_arena", "basketball_stadium",
    "football_stadium", "sports_complex", "baseball_field", "soccer_field", "race_track",
    "golf_course", "tennis_court", "swimming_pool", "gym", "fitness_center",
    "sport_or_fitness_facility", "sport_or_recreation_club", "yoga_studio",
    "fitness_trainer", "martial_arts_club", "dance_studio", "boot_camp", "bowling_alley",
    "ice_skating_rink", "skate_park", "rock_climbing_spot", "mountain_bike_trail",
    "professional_sport_team", "amateur_sport_league", "sports_clubs_and_leagues",
]
OPEN_SPACE_LEAVES = ["park", "dog_park", "public_plaza", "public_fountain",
                     "community_center", "public_space"]
TOP_LEVEL_BUCKET = {
    "food_and_drink": "retail_food_entertainment",
    "shopping": "retail_food_entertainment",
    "arts_and_entertainment": "retail_food_entertainment",
    "lodging": "hotel",
    "services_and_business": "office",
    "health_care": "office",
    "sports_and_recreation": "sport",
    "community_and_government": "other",
    "travel_and_transportation": "other",
    "cultural_and_historic": "other",
    "education": "other",
    "lifestyle_services": "other",
    "geographic_entities": "other",
}

# Ordered keyword families used to infer the top level of a leaf category.
TOP_LEVEL_KEYWORDS = [
    ("food_and_drink", ["restaurant", "cafe", "coffee", "bar", "pub", "brewery", "bakery",
                        "food", "diner", "eatery", "pizz", "steakhouse", "winery",
                        "ice_cream", "deli", "smoothie", "juice_bar", "grill", "bistro",
                        "brunch", "tea_", "donut", "dessert"]),
    ("health_care", ["hospital", "clinic", "doctor", "dentist", "dental", "medical",
                     "urgent_care", "physician", "veterinar", "optometr", "chiropract",
                     "pharmacy", "health_"]),
    ("shopping", ["store", "shop", "market", "retail", "boutique", "mall", "grocery",
                  "supermarket", "dealer", "dealership", "supply", "outlet", "pawn"]),
    ("arts_and_entertainment", ["theater", "theatre", "cinema", "museum", "gallery",
                                "nightclub", "casino", "arcade", "entertainment",
                                "music_venue", "concert", "amusement", "art_"]),
    ("education", ["school", "university", "college", "education", "library", "academy",
                   "kindergarten", "tutoring", "vocational"]),
    ("sports_and_recreation", ["gym", "fitness", "sports", "stadium", "arena", "recreation",
                               "athletic", "martial", "climbing"]),
    ("travel_and_transportation", ["station", "transit", "transport", "airport", "terminal",
                                   "taxi", "car_rental", "ferry", "subway", "railway"]),
    ("services_and_business", ["service", "agency", "agencies", "law", "attorney", "legal",
                               "consult", "accounting", "insurance", "bank", "financial",
                               "finance", "real_estate", "realtor", "office", "coworking",
                               "telecommunication", "roofing", "gutter", "plumb",
                               "electric", "contractor", "repair", "automotive", "auto_",
                               "marketing", "advertis", "notary", "passport", "staffing",
                               "employment", "printing", "logistics", "salon", "barber",
                               "spa", "tech", "software", "it_"]),
]

# Ordered substring rules; the first bucket with a hit wins.
SUBSTRING_RULES = [
    ("parking", ["parking", "garage"]),
    ("hotel", ["hotel", "motel", "hostel", "lodging", "accommodation", "resort",
               "bed_and_breakfast", "inn"]),
    ("sport", ["sport", "stadium", "arena", "fitness", "gym", "athletic", "golf", "bowling",
               "skating", "recreation_center", "climbing", "martial_arts", "yoga", "dance",
               "tennis"]),
    ("open_space", ["park", "garden", "plaza", "trail", "playground", "nature", "beach",
                    "campground", "botanical"]),
    ("office", ["office", "professional", "financial", "bank", "insurance", "real_estate",
                "legal", "lawyer", "accounting", "coworking", "corporate", "software",
                "consulting", "advertising", "architect", "engineering"]),
    ("residential", ["residential", "apartment", "condo", "housing"]),
    ("retail_food_entertainment", ["restaurant", "bar", "cafe", "coffee", "food",
                                   "eat_and_drink", "retail", "shop", "store", "shopping",
                                   "market", "mall", "brewery", "winery", "distillery",
                                   "nightlife", "club", "entertainment", "arts", "theater",
                                   "theatre", "cinema", "movie", "music", "gallery",
                                   "museum", "grocery", "bakery", "pub"]),
]

# Occupancy code prefixes; the longest matching prefix wins.
OCCUPANCY_PREFIX_BUCKET = {
    "RES4": "hotel",
    "RES": "residential",
    "COM10": "parking",
    "COM1": "retail_food_entertainment",
    "COM2": "retail_food_entertainment",
    "COM3": "retail_food_entertainment",
    "COM4": "office",
    "COM5": "office",
    "COM6": "other",
    "COM7": "office",
    "COM8": "retail_food_entertainment",
    "COM9": "retail_food_entertainment",
    "COM": "retail_food_entertainment",
    "IND": "other",
    "AGR": "open_space",
    "REL": "institutional",
    "GOV": "institutional",
    "EDU": "institutional",
    "PUB": "institutional",
}
OCCUPANCY_GROUPS = ["residential", "hotel/institutional", "retail", "office",
                    "entertainment", "industrial/service", "civic/medical", "parking", "other"]

# Building program rules.
VENUE_MIN_AREA_M2 = 4000
VENUE_NAME_TOKENS = ["stadium", "arena", "ballpark", "coliseum", "speedway", "velodrome",
                     "racetrack", "fieldhouse"]
VENUE_NAME_SUFFIXES = ["park", "field", "dome", "bowl", "garden", "forum"]
BUILDING_TAG_PROGRAM = {
    "stadium": "sport", "sports_hall": "sport", "sports_centre": "sport",
    "sports_center": "sport", "pavilion": "sport",
    "hotel": "hotel", "motel": "hotel", "hostel": "hotel",
    "apartments": "residential", "house": "residential", "residential": "residential",
    "terrace": "residential", "bungalow": "residential", "dormitory": "residential",
    "detached": "residential", "semidetached_house": "residential",
    "retail": "retail_food_entertainment", "supermarket": "retail_food_entertainment",
    "commercial": "retail_food_entertainment", "shop": "retail_food_entertainment",
    "restaurant": "retail_food_entertainment", "kiosk": "retail_food_entertainment",
    "office": "office", "school": "office", "university": "office", "college": "office",
    "civic": "office", "government": "office", "public": "office",
    "parking": "parking", "garage": "parking", "garages": "parking", "carport": "parking",
    "warehouse": "other", "industrial": "other", "church": "other", "cathedral": "other",
    "mosque": "other", "temple": "other", "chapel": "other",
}
RESIDENTIAL_BUILDING_TAGS = ["apartments", "residential", "house", "houses", "detached",
                             "semidetached_house", "terrace", "dormitory", "bungalow"]

# Stadium detector thresholds and tags.
STADIUM_MIN_AREA = 4000.0
STADIUM_HUGE_AREA = 22000.0
STADIUM_HUGE_COMPACTNESS = 0.55
STADIUM_MASSIVE_AREA = 28000.0
STADIUM_BUILDING_TAGS = ["stadium", "arena", "sports_centre", "sports_hall"]

# Residential attribute test.
ATTR_RESIDENTIAL_TOKENS = ["apartment", "apartments", "condominium", "condo", "dormitory",
                           "residential", "dwelling", "multifamily", "multi_family",
                           "single_family", "townhouse", "townhome", "duplex", "housing"]
ATTR_EXCLUDED_SUBSTRINGS = ["warehous", "courthouse", "clubhouse", "guesthouse", "household",
                            "real_estate", "funeral", "non_residential", "nonresidential"]
ATTR_RESIDENTIAL_SUBSTRINGS = ["residential", "housing", "dwelling"]

# Residential audit of leaf categories.
AUDIT_EXCLUDED_SUBSTRINGS = [
    "warehous", "courthouse", "clubhouse", "house_of", "steakhouse", "alehouse",
    "lighthouse", "powerhouse", "guesthouse", "bathhouse", "roadhouse", "smokehouse",
    "farmhouse", "funeral", "real_estate", "household", "opera_house",
]
AUDIT_TOKENS = ["apartment", "apartments", "condominium", "condominiums", "condo", "condos",
                "dormitory", "dormitories", "dorm", "tenement", "tenements"]
AUDIT_COMPOUNDS = [
    "student_housing", "assisted_living", "senior_living", "independent_living",
    "retirement_community", "retirement_home", "nursing_home", "care_home", "mobile_home",
    "manufactured_home", "co_living", "coliving", "multi_family", "multifamily",
    "residence_hall", "public_housing", "affordable_housing", "housing_development",
    "housing_authority", "housing_cooperative", "service_apartment", "serviced_apartment",
    "townhouse", "townhome", "gated_community",
]
AUDIT_SUBSTRINGS = ["residential", "housing", "dwelling"]

# Transit.
TRANSIT_LEAVES = ["subway_station", "train_station", "transit_station", "metro_station",
                  "light_rail_station", "bus_station", "bus_stop", "public_transit"]
MIDDAY_START_S = 10 * 3600
MIDDAY_END_S = 15 * 3600
SERVICE_DAY_MAX_S = 28 * 3600
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]

# Streets.
VEHICULAR_CLASSES = ["motorway", "motorway_link", "trunk", "trunk_link", "primary",
                     "primary_link", "secondary", "secondary_link", "tertiary",
                     "tertiary_link", "residential", "unclassified", "living_street",
                     "service"]
WALKABLE_CLASSES = ["footway", "cycleway", "path", "pedestrian", "steps", "residential",
                    "service", "living_street", "unclassified", "tertiary", "secondary",
                    "tertiary_link", "secondary_link", "primary", "primary_link"]
ROAD_WIDTHS_M = {
    "motorway": 14, "motorway_link": 10, "trunk": 14, "trunk_link": 10,
    "primary": 12, "primary_link": 9, "secondary": 10, "secondary_link": 8,
    "tertiary": 8, "tertiary_link": 6, "residential": 6, "unclassified": 6,
    "living_street": 5, "service": 5, "footway": 2, "cycleway": 2, "path": 2,
    "pedestrian": 4, "steps": 2, "track": 2,
}
ROAD_DEFAULT_WIDTH_M = 6
LANE_WIDTH_M = 3.5
ROAD_SKIPPED_CLASSES = ["proposed", "construction", "abandoned", "razed", "disused"]
WALK_SPEED_MPH = 3.0
WALK_MINUTES = [5, 10, 15]
M_PER_FT = 0.3048

# Land cover.
LAND_COVER = {10: "tree", 20: "shrub", 30: "grass", 40: "crop", 50: "builtup", 60: "bare",
              70: "snow", 80: "water", 90: "wetland", 95: "mangrove", 100: "moss"}
GREEN_CLASSES = [10, 20, 30, 40, 90, 95]
GREEN_PATCH_MIN_HA = 0.5
SOIL_RUNOFF_WEIGHT = {"A": 0.0, "B": 0.33, "C": 0.66, "D": 1.0, "A/D": 0.5, "B/D": 0.66,
                      "C/D": 0.83}
SURFACE_TEMP_SCALE, SURFACE_TEMP_OFFSET = 0.00341802, 149.0
REFLECTANCE_SCALE, REFLECTANCE_OFFSET = 0.0000275, -0.2
CANOPY_MIN_PIXELS = 500
CANOPY_MIN_FRACTION = 0.10
VECTOR_DEQUANT_DIVISOR = 127.5
VECTOR_NODATA = -128

# Census.
ACS_VARIABLES = {
    "B01003_001E": "total_pop", "B01002_001E": "median_age",
    "B19013_001E": "median_household_income", "B23025_005E": "unemployed",
    "B23025_002E": "labor_force", "B25077_001E": "median_home_value",
    "B25064_001E": "median_gross_rent", "B25003_002E": "owner_occupied",
    "B25003_003E": "renter_occupied", "B25003_001E": "occupied_total",
    "B15003_001E": "edu_total_pop_25plus", "B15003_022E": "edu_bachelors",
    "B15003_023E": "edu_masters", "B15003_024E": "edu_professional",
    "B15003_025E": "edu_doctorate", "B02001_001E": "race_total",
    "B02001_002E": "race_white", "B02001_003E": "race_black", "B02001_005E": "race_asian",
    "B03003_003E": "hispanic",
}
ACS_FIRST_YEAR_DEFAULT = 2009
ACS_FIRST_YEAR = {"B15003_001E": 2012, "B15003_022E": 2012, "B15003_023E": 2012,
                  "B15003_024E": 2012, "B15003_025E": 2012, "B23025_005E": 2010,
                  "B23025_002E": 2010}
ACS_NULL_SENTINELS = [-666666666, -555555555, -333333333, -222222222, -888888888]
DEMOGRAPHIC_FEATURES = ["median_household_income_pop_weighted", "median_age_pop_weighted",
                        "pct_renter_occupied", "pct_bachelors_or_higher",
                        "estimated_population", "unemployment_rate", "pct_white",
                        "pct_black", "pct_asian", "pct_hispanic"]
LOG_DEMOGRAPHICS = ["estimated_population"]
NODE_DEMOGRAPHICS = ["total_pop", "median_age", "median_household_income",
                     "median_home_value", "median_gross_rent", "race_white", "race_black",
                     "race_asian", "hispanic", "edu_bachelors", "edu_masters",
                     "owner_occupied", "renter_occupied"]

# Jobs.
SECTOR_ROLLUP = {
    "office_knowledge": ["CNS09", "CNS10", "CNS11", "CNS12", "CNS13", "CNS14"],
    "retail": ["CNS07"],
    "accommodation_food": ["CNS18"],
    "arts_recreation": ["CNS17"],
    "health": ["CNS16"],
    "education": ["CNS15"],
    "industrial_logistics": ["CNS01", "CNS02", "CNS03", "CNS04", "CNS05", "CNS06", "CNS08"],
    "public_admin": ["CNS20"],
    "other_services": ["CNS19"],
}
CONSUMER_SECTORS = ["retail", "accommodation_food", "arts_recreation"]
SECTOR_COLUMNS = [f"CNS{i:02d}" for i in range(1, 21)]
JOB_COLUMNS = (["C000"] + SECTOR_COLUMNS + ["CE01", "CE02", "CE03", "CA01", "CA02", "CA03",
               "CD01", "CD02", "CD03", "CD04", "CFA01", "CFA02", "CFA03", "CFA04", "CFA05",
               "CFS01", "CFS02", "CFS03", "CFS04", "CFS05"])

# Region codes of Canadian districts (suffix of the district code).
CANADIAN_PROVINCES = ["ON", "QC", "BC", "AB", "MB", "SK", "NS", "NB", "NL", "PE", "NT", "YT",
                      "NU"]

# Feature bands by column prefix, and named sets of bands.
BAND_PREFIXES = {
    "morphology": ["morph_", "wave_", "iex_", "nolli_"],
    "program": ["program_", "prog_", "cat_"],
    "anchor": ["anchor_"],
    "demographics": ["demo_", "census_", "acs_"],
    "ecology": ["mth_"],
    "economic": ["eco_"],
}
HUMAN_BANDS = ["morphology", "program", "anchor", "demographics"]
BAND_SETS = {
    "human": HUMAN_BANDS,
    "ecology": ["ecology"],
    "economic": ["economic"],
    "combined": HUMAN_BANDS + ["ecology", "economic"],
}
FAMILY_PREFIXES = {
    "morphometric": "morph_", "program": "prog_", "anchor": "anchor_",
    "progocc": "progocc_", "demographics": "demo_", "economic": "econ_",
    "connectivity": "conn_",
}
FAMILY_MEMBERS = {
    "livework": ["prog_pct_residential", "prog_pct_office", "prog_pct_sport",
                 "prog_pct_retail_food_entertainment", "prog_pct_hotel"],
    "intensity": ["morph_density_per_km2", "morph_coverage", "anchor_count_inside"],
}

# Building shape columns and the ones that are heavy-tailed.
SHAPE_FEATURES = ["area_m2", "perimeter_m", "equivalent_diameter_m", "max_diameter_m",
                  "mrr_long_side_m", "mrr_short_side_m", "compactness", "hull_ratio",
                  "solidity", "roughness", "bbox_elongation", "mrr_elongation",
                  "eccentricity", "vertex_count", "hu_1", "hu_2", "hu_3", "hu_4", "hu_5",
                  "hu_6", "hu_7"]
SIZE_FEATURES = ["area_m2", "perimeter_m", "equivalent_diameter_m", "max_diameter_m",
                 "mrr_long_side_m", "mrr_short_side_m"]
HU_FEATURES = [f"hu_{i}" for i in range(1, 8)]

# Parcel signal features.
PARCEL_FEATURES = ["ownership_gini", "zoning_diversity", "year_built_median",
                   "vacant_share", "mean_bldg_density_per_acre"]

# Compass.
COMPASS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]

# Thumbnails and caps that are part of the output definition.
THUMBNAIL_MAX_RINGS = 1200
THUMBNAIL_SIMPLIFY = 4.0
THUMBNAIL_MIN_AREA_FRACTION = 0.00003
CANVAS_MAX_BUILDINGS = 20000
AXIS_END_BUFFER_M = 50.0

# Thematic charts: fixed values, x and y feature of each.
THEMATIC_CHARTS = {
    "Density vs coverage": ("morph_coverage", "morph_density_per_km2"),
    "Typical vs anchor scale": ("morph_median_area_m2", "anchor_max_area_ratio"),
    "Planned alignment vs morphological variety": ("morph_orientation_R", "morph_cluster_diversity"),
    "Corporate vs consumer character": ("prog_pct_office", "prog_pct_retail_food_entertainment"),
    "Venue-driven character": ("prog_pct_sport", "prog_pct_hotel"),
    "Open space vs built density": ("prog_pct_open_space", "morph_coverage"),
    "Anchor count vs anchor dominance": ("anchor_count_inside", "anchor_max_area_ratio"),
    "Anchor dominance vs program mix": ("anchor_size_concentration", "prog_diversity"),
    "Scale of the district": ("sad_area_km2", "buildings_inside_count"),
    "Density × corporate concentration": ("morph_coverage", "prog_pct_office"),
    "Master plan signature": ("morph_orientation_R", "morph_coverage"),
    "Anchor signature, two readings": ("morph_area_log_skew", "anchor_max_area_ratio"),
    "Density × wealth": ("demo_population_density", "demo_median_hh_income"),
    "Education × racial diversity": ("demo_pct_bachelors_plus", "demo_racial_diversity"),
    "Density × home values": ("demo_population_density", "demo_median_home_value"),
}

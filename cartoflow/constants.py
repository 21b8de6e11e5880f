"""Fixed values of the data model."""

# Earth and planar approximations, metres.
EARTH_RADIUS_M = 6_371_000.0
METERS_PER_DEGREE = 111_320.0
KM_PER_DEGREE_MOBILE = 111.0

# Hierarchy levels: code, name, tile size in degrees, nominal tile size in km.
HIGHWAY, ARTERIAL, LOCAL = 0, 1, 2
LEVEL_NAME = {0: "highway", 1: "arterial", 2: "local"}
TILE_SIZE_DEG = {0: 1.0, 1: 0.1, 2: 0.01}
TILE_SIZE_KM = {0: 111.0, 1: 11.1, 2: 1.1}

# Road class: highway tag values, code, level, default km/h.
ROAD_CLASSES = [
    (("motorway", "motorway_link"), 0, 0, 120),
    (("trunk", "trunk_link"), 1, 0, 100),
    (("primary", "primary_link"), 2, 0, 80),
    (("secondary", "secondary_link"), 3, 1, 60),
    (("tertiary", "tertiary_link"), 4, 1, 50),
    (("residential",), 5, 2, 30),
    (("service",), 6, 2, 20),
    (("unclassified", "living_street"), 7, 2, 30),
]

# Render codes.
ROAD_PRIMARY, ROAD_SECONDARY, ROAD_HIGHLIGHT = 0, 1, 2
RENDER_PRIMARY = ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link")
RENDER_SECONDARY = ("secondary", "secondary_link", "tertiary", "tertiary_link", "residential", "unclassified", "living_street", "service")
POI_GAS, POI_PARKING, POI_MALL, POI_CAR_WASH, POI_FAST_FOOD = 0, 1, 2, 3, 4
AREA_WATER, AREA_FOREST, AREA_PARK, AREA_GRASS = 0, 1, 2, 3
WATER_RIVER, WATER_STREAM, WATER_CANAL = 0, 1, 2

# Place categories.
SETTLEMENT, STREET, POI, TRANSPORT, NATURAL, OTHER = 0, 1, 2, 3, 4, 255
SETTLEMENT_PLACES = ("city", "town", "village", "hamlet", "suburb", "neighbourhood")
POI_AMENITIES = ("fuel", "restaurant", "cafe", "fast_food", "parking", "hospital", "pharmacy", "bank", "atm", "police", "post_office", "school", "university", "library", "cinema", "theatre")
NATURAL_PLACES = ("peak", "volcano", "water", "bay", "beach", "glacier")

# Flags.
NODE_BOUNDARY, NODE_TRAFFIC_SIGNAL, NODE_BARRIER = 1, 2, 4
EDGE_ONEWAY, EDGE_TUNNEL, EDGE_BRIDGE, EDGE_TOLL = 1, 2, 4, 8

# Routing.
LOCAL_LIMIT_M, ARTERIAL_LIMIT_M = 5_000.0, 50_000.0
HEURISTIC_KMH = 130.0
MAX_NODES = 500_000
WEIGHT_MAX = 4_294_967_295
NAME_MAX = EDGE_MAX = 255
PREFETCH_DEG = {2: 0.02, 1: 0.2, 0: 1.0}

# Viewport.
OFFSET_SCALE = 3000
CLOSE_EPS = 1e-4
ZOOM_MIN, ZOOM_MAX, ZOOM_DEFAULT = 0.75, 3.0, 1.5
SCREEN = 800
VIEW_RADIUS_DEG = 0.015
SEGMENT_MARGIN, POI_MARGIN, AREA_MARGIN = 50.0, 20.0, 100.0

# Positioning.
POSITION_SMOOTHING, HEADING_SMOOTHING = 0.15, 0.2
GOOD_ACCURACY_M, POOR_ACCURACY_M = 20.0, 100.0

# Search.
FETCH, SHOWN = 20, 10

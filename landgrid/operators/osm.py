"""Map data: ways, nodes and tags into roads and points of interest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgrid.functions import geo, pii
from landgrid.functions.normalize import lookup, round_up
from landgrid.operators import areas
from landgrid.session import cut_lineage

# Road classes and surfaces.
ROAD_CLASSES = [
    "motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary",
    "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential", "living_street",
    "service", "track", "road",
]
PAVED = [
    "asphalt", "concrete", "paved", "paving_stones", "concrete:plates", "sett", "cobblestone",
    "concrete:lanes", "metal", "unhewn_cobblestone", "bricks", "chipseal", "brick", "metal_grid",
    "grass_paver", "asfalto", "pavimento",
]
UNPAVED = [
    "unpaved", "ground", "gravel", "dirt", "compacted", "grass", "sand", "earth", "wood",
    "fine_gravel", "pebblestone", "mud", "rock", "clay", "stepping_stones", "stone", "piedra",
    "piedras", "afirmado", "destapada", "tierra",
]
ROAD_TAGS = [
    "highway", "surface", "tracktype", "smoothness", "lanes", "maxspeed", "oneway", "bridge",
    "tunnel", "toll", "access", "ref",
]
POI_TAGS = ["brand", "cuisine", "opening_hours", "wheelchair", "stars", "rooms"]

# The category of each tag value, by tag key. Keys are looked at in this order.
POI_CATEGORIES = {
    "amenity": {
        "restaurant": "alimentacion",
        "fast_food": "alimentacion",
        "cafe": "alimentacion",
        "bar": "alimentacion",
        "ice_cream": "alimentacion",
        "pub": "alimentacion",
        "food_court": "alimentacion",
        "juice_bar": "alimentacion",
        "biergarten": "alimentacion",
        "bank": "financiero",
        "atm": "financiero",
        "money_transfer": "financiero",
        "bureau_de_change": "financiero",
        "payment_centre": "financiero",
        "payment_terminal": "financiero",
        "marketplace": "comercio",
        "pharmacy": "servicios",
        "fuel": "servicios",
        "place_of_worship": "servicios",
        "police": "servicios",
        "community_centre": "servicios",
        "townhall": "servicios",
        "bus_station": "servicios",
        "veterinary": "servicios",
        "post_office": "servicios",
        "library": "servicios",
        "car_wash": "servicios",
        "social_facility": "servicios",
        "childcare": "servicios",
        "fire_station": "servicios",
        "internet_cafe": "servicios",
        "ferry_terminal": "servicios",
        "taxi": "servicios",
        "courthouse": "servicios",
        "social_centre": "servicios",
        "charging_station": "servicios",
        "driving_school": "servicios",
        "language_school": "servicios",
        "music_school": "servicios",
        "car_rental": "servicios",
        "vehicle_inspection": "servicios",
        "animal_boarding": "servicios",
        "animal_shelter": "servicios",
        "nursing_home": "servicios",
        "public_bath": "servicios",
        "studio": "servicios",
        "conference_centre": "servicios",
        "post_depot": "servicios",
        "nightclub": "ocio",
        "theatre": "ocio",
        "casino": "ocio",
        "events_venue": "ocio",
        "arts_centre": "ocio",
        "cinema": "ocio",
        "gambling": "ocio",
        "dojo": "ocio",
    },
    "shop": {
        "supermarket": "alimentacion",
        "convenience": "alimentacion",
        "bakery": "alimentacion",
        "butcher": "alimentacion",
        "greengrocer": "alimentacion",
        "alcohol": "alimentacion",
        "beverages": "alimentacion",
        "confectionery": "alimentacion",
        "pastry": "alimentacion",
        "coffee": "alimentacion",
        "seafood": "alimentacion",
        "farm": "alimentacion",
        "dairy": "alimentacion",
        "deli": "alimentacion",
        "cheese": "alimentacion",
        "health_food": "alimentacion",
        "grocery": "alimentacion",
        "wine": "alimentacion",
        "tea": "alimentacion",
        "chocolate": "alimentacion",
        "car_repair": "servicios",
        "hairdresser": "servicios",
        "beauty": "servicios",
        "travel_agency": "servicios",
        "laundry": "servicios",
        "copyshop": "servicios",
        "motorcycle_repair": "servicios",
        "tyres": "servicios",
        "funeral_directors": "servicios",
        "tailor": "servicios",
        "dry_cleaning": "servicios",
        "massage": "servicios",
        "locksmith": "servicios",
        "repair": "servicios",
        "printing": "servicios",
        "sewing": "servicios",
        "shoe_repair": "servicios",
        "pet_grooming": "servicios",
        "storage_rental": "servicios",
        "photo": "servicios",
        "pawnbroker": "financiero",
        "money_lender": "financiero",
    },
    "tourism": {
        "hotel": "alojamiento",
        "hostel": "alojamiento",
        "guest_house": "alojamiento",
        "camp_site": "alojamiento",
        "alpine_hut": "alojamiento",
        "apartment": "alojamiento",
        "chalet": "alojamiento",
        "motel": "alojamiento",
        "wilderness_hut": "alojamiento",
        "camp_pitch": "alojamiento",
        "caravan_site": "alojamiento",
        "attraction": "turismo",
        "viewpoint": "turismo",
        "artwork": "turismo",
        "information": "turismo",
        "museum": "turismo",
        "picnic_site": "turismo",
        "zoo": "turismo",
        "theme_park": "turismo",
        "gallery": "turismo",
        "aquarium": "turismo",
        "trail_riding_station": "turismo",
    },
    "leisure": {
        "pitch": "ocio",
        "park": "ocio",
        "swimming_pool": "ocio",
        "garden": "ocio",
        "playground": "ocio",
        "sports_centre": "ocio",
        "fitness_centre": "ocio",
        "fitness_station": "ocio",
        "track": "ocio",
        "stadium": "ocio",
        "common": "ocio",
        "resort": "ocio",
        "water_park": "ocio",
        "dog_park": "ocio",
        "sports_hall": "ocio",
        "recreation_ground": "ocio",
        "dance": "ocio",
        "adult_gaming_centre": "ocio",
        "marina": "ocio",
        "golf_course": "ocio",
        "beach_resort": "ocio",
        "amusement_arcade": "ocio",
        "horse_riding": "ocio",
        "sauna": "ocio",
        "trampoline_park": "ocio",
    },
    "office": {
        "financial": "financiero",
        "insurance": "financiero",
    },
    "craft": {
    },
    "historic": {
        "memorial": "turismo",
        "monument": "turismo",
        "building": "turismo",
        "archaeological_site": "turismo",
        "wayside_shrine": "turismo",
        "ruins": "turismo",
        "tomb": "turismo",
        "wayside_cross": "turismo",
        "manor": "turismo",
        "camino_real": "turismo",
        "castle": "turismo",
    },
}
# The category of all other values of a key.
POI_OTHERS = {
    "shop": "comercio",
    "office": "servicios",
    "craft": "servicios",
}
# Values that are no place of business.
POI_EXCLUDED = {
    "amenity": [
        "school",
        "college",
        "university",
        "kindergarten",
        "hospital",
        "clinic",
        "doctors",
        "dentist",
        "parking",
        "parking_space",
        "parking_entrance",
        "bicycle_parking",
        "motorcycle_parking",
        "bench",
        "waste_basket",
        "toilets",
        "drinking_water",
        "fountain",
        "shelter",
        "telephone",
        "post_box",
        "public_bookcase",
        "bicycle_repair_station",
        "vending_machine",
        "clock",
        "bbq",
        "shower",
        "table",
        "waste_transfer_station",
        "waste_disposal",
        "recycling",
        "sanitary_dump_station",
        "loading_dock",
        "water_point",
        "watering_place",
        "grave_yard",
        "crematorium",
        "prison",
        "public_building",
        "animal_breeding",
        "hunting_stand",
        "monastery",
        "research_institute",
        "brothel",
        "stripclub",
        "love_hotel",
        "bicycle_rental",
        "car_pooling",
        "reception_desk",
        "office",
        "ranger_station",
    ],
    "shop": [
        "vacant",
        "no",
    ],
    "leisure": [
        "nature_reserve",
        "nature_wood",
        "bleachers",
        "outdoor_seating",
        "picnic_table",
        "slipway",
        "bird_hide",
        "hot_tub",
        "fishing",
        "proposed",
    ],
}

# Tag keys that carry personal data.
PERSONAL_TAGS = [
    ("phone", "(?i)(^|:)(phone|mobile|fax|whatsapp)(:|$)"),
    ("email", "(?i)(^|:)e?-?mail(:|$)"),
    ("operator", "(?i)^(operator|owner)(:(email|phone|mobile|name|short|website))?$"),
    ("address", "(?i)^addr:(street|housenumber|housename|unit|full|flats|door|block_number)$"),
    ("social", "(?i)^contact:"),
    ("free_text", "(?i)^(description|note|notes|fixme|comment)$"),
]


def tag(name: str, tags: str = "tags") -> Column:
    return F.try_element_at(F.col(tags), F.lit(name))


def is_paved(surface: Column) -> Column:
    """TRUE, FALSE or, for surfaces nobody listed, NULL; mixed values count by their first."""
    s = F.lower(F.trim(surface))
    head = F.trim(F.regexp_extract(s, "^[^/,;+]*", 0))
    return (
        F.when(s.isin(PAVED), True).when(s.isin(UNPAVED), False)
        .when(head.isin(PAVED), True).when(head.isin(UNPAVED), False)
    )


def lanes(text: Column) -> Column:
    n = F.regexp_extract(text, "^\\s*([0-9]{1,2})", 1).try_cast("int")
    return F.when(n.between(1, 20), n)


def max_speed_kmh(text: Column) -> Column:
    pattern = "(?i)^\\s*([0-9]{1,3})\\s*(mph|km/h|kmh)?\\s*$"
    n = F.regexp_extract(text, pattern, 1).try_cast("double")
    miles = F.lower(F.regexp_extract(text, pattern, 2)) == "mph"
    kmh = F.when(miles, round_up(n * 1.609344, 0)).otherwise(n).cast("int")
    return F.when(kmh.between(5, 150), kmh)


def roads(ways: DataFrame) -> DataFrame:
    """Ways of a road class with their cleaned attributes."""
    name = F.trim(tag("name"))
    kept = ways.where(tag("highway").isin(ROAD_CLASSES))
    return kept.withColumns(
        {
            "class": tag("highway"), "name": F.when(name != "", name),
            "surface": tag("surface"), "is_paved": is_paved(tag("surface")),
            "lanes": lanes(tag("lanes")), "max_speed_kmh": max_speed_kmh(tag("maxspeed")),
        }
    )


def classify_pois(places: DataFrame, tags: str = "tags") -> DataFrame:
    """Adds ``verdict`` (poi, excluded, unmapped, none), ``category``, ``subcategory`` and ``problem_tag``.

    The first key that yields a category decides; without any, the first key
    that was excluded or unknown is reported.
    """
    found, problem = [], []
    for key, known in POI_CATEGORIES.items():
        value = F.trim(tag(key, tags))
        hit = lookup(value, known) if known else F.lit(None).cast("string")
        dropped = value.isin(POI_EXCLUDED[key]) if key in POI_EXCLUDED else F.lit(False)
        category = F.coalesce(hit, F.lit(POI_OTHERS[key])) if key in POI_OTHERS else hit
        usable = (value != "") & category.isNotNull() & ~dropped
        found.append(F.when(usable, F.struct(category.alias("category"), value.alias("sub"))))
        kind = F.when(dropped, "excluded").otherwise("unmapped")
        problem.append(
            F.when((value != "") & ~usable, F.struct(kind.alias("kind"), F.concat(F.lit(key + "="), value).alias("tag")))
        )
    df = places.withColumns({"_found": F.coalesce(*found), "_problem": F.coalesce(*problem)})
    verdict = F.when(F.col("_found").isNotNull(), "poi").otherwise(F.coalesce("_problem.kind", F.lit("none")))
    return df.withColumns(
        {
            "verdict": verdict, "category": F.col("_found.category"), "subcategory": F.col("_found.sub"),
            "problem_tag": F.when(F.col("_found").isNull(), F.col("_problem.tag")),
        }
    ).drop("_found", "_problem")


def keep_tags(tags: Column, allowed: list[str]) -> Column:
    """The allowed tags with text."""
    return F.map_filter(tags, lambda k, v: k.isin(allowed) & (v != ""))


def personal_tag_rule(key: Column) -> Column:
    chain = F.when(F.lit(False), None)
    for rule, pattern in PERSONAL_TAGS:
        chain = chain.when(key.rlike(pattern), rule)
    return chain


def dropped_tags(places: DataFrame, allowed: list[str], tags: str = "tags") -> DataFrame:
    """How often each personal tag was left out, by rule."""
    keys = places.select(F.explode(F.map_keys(tags)).alias("key")).where(~F.col("key").isin(allowed))
    counted = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("rule", personal_tag_rule(F.col("key"))).where("rule is not null")


def safe_name(name: Column) -> Column:
    """The name, or NULL when it holds an address of mail or a phone number."""
    text = F.trim(name)
    bad = text.rlike(pii.EMAIL) | text.rlike(pii.PHONE)
    return F.when((text != "") & ~bad, text)


def assemble_ways(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Lines and mean points of ways from their node references, with the missing nodes counted.

    A way has a bounded number of references, so its points are collected.
    """
    refs = ways.select("way_id", F.posexplode("refs").alias("at", "node_id"))
    hit = refs.join(nodes.select("node_id", "lng", "lat"), "node_id", "left")
    at = F.when(F.col("lng").isNotNull(), F.struct("at", F.struct(F.col("lng").alias("x"), F.col("lat").alias("y")).alias("p")))
    grouped = hit.groupBy("way_id").agg(
        F.transform(F.sort_array(F.collect_list(at)), lambda s: s["p"]).alias("line"),
        F.count_if(F.col("lng").isNull()).alias("missing_nodes"),
        F.avg("lng").alias("lng"), F.avg("lat").alias("lat"),
    )
    return ways.join(grouped, "way_id", "left")


def load_report(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows per class or category, those with a name, and the municipalities they are in."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count("name").alias("named"), F.countDistinct("muni_code").alias("municipalities")
    )


def enrich(ways: DataFrame, nodes: DataFrame, municipalities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roads and points of interest with geometry, category and municipality.

    Roads take the municipality of the middle of their line, points their own.
    """
    # Both outputs start from the assembled ways.
    shaped = cut_lineage(assemble_ways(ways, nodes))
    lines = cut_lineage(
        roads(shaped).where(F.size("line") >= 2).withColumn("_m", geo.line_midpoint(F.col("line")))
    )
    middles = lines.select("way_id", F.col("_m.x").alias("lng"), F.col("_m.y").alias("lat"))
    own = areas.municipality_of(middles, municipalities, "way_id").select("way_id", "muni_code")
    road_rows = lines.drop("_m").join(own, "way_id", "left")
    closed = shaped.select("way_id", "tags", "lng", "lat")
    single = nodes.where("tags is not null").select(F.col("node_id").alias("way_id"), "tags", "lng", "lat")
    pois = classify_pois(closed.unionByName(single)).where("verdict = 'poi' and lng is not null")
    pois = cut_lineage(
        pois.withColumns({"name": safe_name(tag("name")), "tags": keep_tags(F.col("tags"), POI_TAGS)})
    )
    poi_muni = areas.municipality_of(pois.select("way_id", "lng", "lat"), municipalities, "way_id").select("way_id", "muni_code")
    return road_rows, pois.join(poi_muni, "way_id", "left")

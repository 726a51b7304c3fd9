"""Classification expressions. Each takes columns and returns a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from townloom.functions import vocab as V
from townloom.functions.num import col, contains_any, word_tokens


def _clean(c) -> Column:
    return F.trim(F.lower(F.coalesce(col(c), F.lit(""))))


def lookup(c, table: dict, default=None) -> Column:
    """A fixed dictionary as a map literal: constant folded, no join needed."""
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    found = F.try_element_at(F.create_map(*pairs), c)
    return found if default is None else F.coalesce(found, F.lit(default))


def _leaf_bucket(leaf: Column, residential: str) -> Column:
    return (F.when(leaf.isin(V.PARKING_LEAVES), "parking")
            .when(leaf.isin(V.RESIDENTIAL_LEAVES), residential)
            .when(leaf.isin(V.HOTEL_LEAVES), "hotel")
            .when(leaf.isin(V.SPORT_LEAVES), "sport")
            .when(leaf.isin(V.OPEN_SPACE_LEAVES), "open_space"))


def bucket_with_top_level(leaf, top_level) -> Column:
    """Exact leaf sets, then the top level; residential leaves become other."""
    return F.coalesce(_leaf_bucket(_clean(leaf), "other"),
                      lookup(F.coalesce(col(top_level), F.lit("")), V.TOP_LEVEL_BUCKET, "other"))


def infer_top_level(leaf) -> Column:
    """The first keyword family that occurs in the leaf."""
    text = F.lower(F.coalesce(col(leaf), F.lit("")))
    out = None
    for family, words in V.TOP_LEVEL_KEYWORDS:
        hit = contains_any(text, words)
        if family == "sports_and_recreation":
            hit = hit | (text.contains("sport") & ~text.contains("passport"))
        out = F.when(hit, family) if out is None else out.when(hit, family)
    return out


def bucket_from_leaf(leaf) -> Column:
    text = _clean(leaf)
    top = F.coalesce(infer_top_level(text), F.lit(""))
    return F.coalesce(_leaf_bucket(text, "residential"),
                      lookup(top, V.TOP_LEVEL_BUCKET, "other"))


def bucket_with_alternates(leaf, alternates) -> Column:
    """Like bucket_from_leaf; when other, the first alternate that is not other."""
    first = bucket_from_leaf(leaf)
    buckets = F.filter(F.transform(col(alternates), bucket_from_leaf), lambda b: b != "other")
    other = F.coalesce(F.try_element_at(buckets, F.lit(1)), F.lit("other"))
    return F.when(first != "other", first).otherwise(other)


def bucket_by_substring(category) -> Column:
    """Ordered substring rules, first hit wins."""
    text = F.lower(F.coalesce(col(category), F.lit("")))
    out = F.when(text == "", "other")
    for bucket, words in V.SUBSTRING_RULES:
        out = out.when(contains_any(text, words), bucket)
    return out.otherwise("other")


def occupancy_bucket(code) -> Column:
    """C4: the longest occupancy prefix wins."""
    text = F.upper(F.coalesce(col(code), F.lit("")))
    prefixes = sorted(V.OCCUPANCY_PREFIX_BUCKET, key=lambda k: -len(k))
    out = None
    for prefix in prefixes:
        hit, bucket = text.startswith(prefix), V.OCCUPANCY_PREFIX_BUCKET[prefix]
        out = F.when(hit, bucket) if out is None else out.when(hit, bucket)
    return out.otherwise("other")


def occupancy_group(code) -> Column:
    """Family and number of an occupancy code to nine groups."""
    text = F.coalesce(col(code), F.lit(""))
    family = F.regexp_extract(text, r"^([A-Z]+)(\d+)", 1)
    number = F.regexp_extract(text, r"^([A-Z]+)(\d+)", 2).try_cast("int")
    com = (F.when(number == 1, "retail").when(number == 4, "office")
           .when(number.isin(8, 9), "entertainment")
           .when(number.isin(2, 3), "industrial/service").otherwise("civic/medical"))
    return (F.when(number.isNull(), "other")
            .when(family == "RES", F.when(number == 4, "hotel/institutional")
                  .otherwise("residential"))
            .when(family == "COM", com)
            .when(family.isin("IND", "AGR"), "industrial/service")
            .when(family.isin("REL", "EDU", "GOV"), "civic/medical")
            .otherwise("other"))


def occupancy_group_with_parking(code, dominant_program) -> Column:
    return F.when(_clean(dominant_program) == "parking", "parking").otherwise(
        occupancy_group(code))


def building_program(name, area, tag, dominant_program) -> Column:
    """Venue name of a large building, then its tag, then the dominant program inside."""
    n = F.trim(F.lower(F.coalesce(col(name), F.lit(""))))
    n = F.when(n.contains("("), F.trim(F.substring_index(n, "(", 1))).otherwise(n)
    words = F.size(F.filter(F.split(n, r"\s+"), lambda w: w != ""))
    ends = n.rlike("(^| )(%s)$" % "|".join(V.VENUE_NAME_SUFFIXES))
    venue = (F.coalesce(col(area), F.lit(0.0)) > V.VENUE_MIN_AREA_M2) & (
        contains_any(n, V.VENUE_NAME_TOKENS) | (ends & (words >= 2)))
    return F.coalesce(F.when(venue, "sport"),
                      lookup(_clean(tag), V.BUILDING_TAG_PROGRAM),
                      F.nullif(col(dominant_program), F.lit("")), F.lit("other"))


def is_stadium(area, compactness, program, building_tag, leisure, amenity, sport,
               sport_inside) -> Column:
    """Large and (tagged, or with a sport place inside, or arena-like in form)."""
    area, program = col(area), F.coalesce(col(program), F.lit(""))
    tagged = (_clean(building_tag).isin(V.STADIUM_BUILDING_TAGS)
              | (_clean(leisure) == "stadium") | (_clean(amenity) == "stadium")
              | (F.coalesce(col(sport), F.lit("")) != "") | (program == "sport"))
    form = ((area > V.STADIUM_HUGE_AREA) & (col(compactness) > V.STADIUM_HUGE_COMPACTNESS)
            ) | (area > V.STADIUM_MASSIVE_AREA)
    return ((area >= V.STADIUM_MIN_AREA) & ~program.isin("open_space", "parking")
            & (tagged | (F.coalesce(col(sport_inside), F.lit(0)) >= 1) | form))


def attribute_is_residential(value) -> Column:
    """Token set and substrings behind a veto list."""
    text = _clean(value)
    tokens = F.array(*[F.lit(t) for t in V.ATTR_RESIDENTIAL_TOKENS])
    return ((text != "") & ~contains_any(text, V.ATTR_EXCLUDED_SUBSTRINGS)
            & (F.arrays_overlap(word_tokens(text), tokens)
               | contains_any(text, V.ATTR_RESIDENTIAL_SUBSTRINGS)))


def residential_rule(leaf) -> Column:
    """Which audit rule matched, or an empty string."""
    text = _clean(leaf)
    tokens = F.array(*[F.lit(t) for t in V.AUDIT_TOKENS])
    return (F.when((text == "") | contains_any(text, V.AUDIT_EXCLUDED_SUBSTRINGS), "")
            .when(F.arrays_overlap(word_tokens(text), tokens), "token")
            .when(contains_any(text, V.AUDIT_COMPOUNDS), "compound")
            .when(contains_any(text, V.AUDIT_SUBSTRINGS), "substr").otherwise(""))


def station_kind(railway, public_transport, amenity, highway) -> Column:
    """The kind of a transit station; see station_tier for its rank."""
    return (F.when(col(railway) == "station", "rail_station")
            .when(col(public_transport) == "station", "public_transport_station")
            .when(col(amenity) == "bus_station", "bus_station")
            .when(col(railway) == "subway_entrance", "subway_entrance")
            .when(col(railway) == "tram_stop", "tram_stop")
            .when(col(highway) == "bus_stop", "bus_stop").otherwise("unknown"))


def station_tier(kind) -> Column:
    return (F.when(col(kind).isin("rail_station", "public_transport_station", "bus_station"), 1)
            .when(col(kind).isin("subway_entrance", "tram_stop"), 2).otherwise(3))


def route_mode(route_type) -> Column:
    """C11: base and extended route types to a mode."""
    t = col(route_type).try_cast("int")
    return (F.when((t == 0) | t.between(900, 999), "tram")
            .when((t == 1) | t.between(400, 499), "subway")
            .when((t == 2) | t.between(100, 199), "rail")
            .when((t == 3) | t.between(700, 799) | (t == 11), "bus")
            .when((t == 4) | t.between(1000, 1199), "ferry")
            .when(t == 5, "cable")
            .when((t == 12) | t.between(1200, 1299), "monorail").otherwise("other"))


def canonical_typology(value) -> Column:
    """Aliases resolved; placeholders such as 'unspecified' are NULL."""
    text = F.trim(col(value))
    real = F.when(~F.lower(text).isin(V.UNSPECIFIED_TYPOLOGY), text)
    return F.coalesce(lookup(real, V.TYPOLOGY_ALIASES), real)


def is_canadian(code) -> Column:
    return F.regexp_extract(col(code), r"-([A-Z]{2})$", 1).isin(V.CANADIAN_PROVINCES)


def density_tag(coverage) -> Column:
    """Built coverage to a density word."""
    v = col(coverage)
    return (F.when(v >= 0.25, "high-density urban").when(v >= 0.15, "medium-density urban")
            .when(v >= 0.08, "moderate-density").when(v >= 0.0, "low-density / suburban")
            .otherwise("low-density"))


def program_tags(office, retail, sport, hotel, residential) -> Column:
    """Program words in order of strength; mixed-program when none applies."""
    office, retail, sport = col(office), col(retail), col(sport)
    tags = F.array_compact(F.array(
        F.when(office >= 45, "office-dominated").when(office >= 30, "office-rich"),
        F.when(retail >= 35, "retail-led").when(retail >= 25, "retail-rich"),
        F.when(sport >= 7, "sport-anchored").when(sport >= 3, "with notable sport presence"),
        F.when(col(hotel) >= 4, "hospitality-supported"),
        F.when(col(residential) >= 10, "residentially integrated")))
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("mixed-program")))


def anchor_structure(count, max_ratio) -> Column:
    n = col(count)
    return (F.when(col(max_ratio) >= 0.20, "monolithic-anchor").when(n >= 5, "multi-anchor")
            .when(n >= 2, "few-anchor").when(n >= 1, "single-anchor").otherwise("anchor-light"))


def family_descriptor(area, elongation, vertices, compactness) -> Column:
    """Size word and form words of a footprint family."""
    size = F.when(col(area) >= 800, "large").when(col(area) < 80, "small").otherwise("mid")
    form = (F.when(col(vertices) >= 14, "complex").when(col(compactness) >= 0.72, "compact"))
    return F.concat_ws("-", size, F.when(col(elongation) >= 2.3, "elongated"), form)


def feature_band(feature) -> Column:
    """The first band with a matching prefix; NULL for unprefixed features."""
    f = col(feature)
    out = None
    for band, prefixes in V.BAND_PREFIXES.items():
        hit = f.rlike("^(%s)" % "|".join(prefixes))
        out = F.when(hit, band) if out is None else out.when(hit, band)
    return out


def in_band_set(feature, name: str) -> Column:
    """Features of the selected bands; unprefixed ones belong to the human bands."""
    bands = V.BAND_SETS[name]
    human = bool(set(bands) & set(V.HUMAN_BANDS))
    return F.coalesce(feature_band(feature).isin(bands), F.lit(human))


def in_family(feature, family: str) -> Column:
    """Membership of a feature in a metric family."""
    f = col(feature)
    if family == "all":
        return F.lit(True)
    if family in V.FAMILY_MEMBERS:
        return f.isin(V.FAMILY_MEMBERS[family])
    return f.startswith(V.FAMILY_PREFIXES[family])

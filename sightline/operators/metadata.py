"""Interpretation of raw metadata: position, capture time, input class, and times in common."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import spread

#: The keys that are interpreted.
LATITUDE, LATITUDE_REF = "GPS GPSLatitude", "GPS GPSLatitudeRef"
LONGITUDE, LONGITUDE_REF = "GPS GPSLongitude", "GPS GPSLongitudeRef"
DATUM = "GPS GPSMapDatum"
TIME, OFFSET = "EXIF DateTimeOriginal", "EXIF OffsetTimeOriginal"
REQUIRED = (LATITUDE, LATITUDE_REF, LONGITUDE, LONGITUDE_REF)
#: Names of aerial cameras, in normalised text.
AERIAL = (r"\bmavic\b", r"\bphantom\b", r"\binspire\b", r"\bmatrice\b", r"\bavata\b", r"\banafi\b", r"\bskydio\s+(?:2\+?|x2|x10)\b", r"\bautel(?:\s+robotics)?\s+evo\b")
CAMERA_KEYS = ("image make", "image model")
NUMBER = r"\s*([0-9]+(?:\.[0-9]+)?)(?:/([0-9]+(?:\.[0-9]+)?))?\s*"
DMS = rf"^\s*\[{NUMBER},{NUMBER},{NUMBER}\]\s*$"


def dms_to_degrees(value: Column) -> Column:
    """Degrees of "[d, m, s]", each a number or a fraction; null if it is not one or m or s reach 60."""

    def part(text: Column) -> Column:
        below = F.split_part(text, F.lit("/"), F.lit(2))
        return F.split_part(text, F.lit("/"), F.lit(1)).cast("double") / F.when(below == "", 1.0).otherwise(F.nullif(F.when(below != "", below).cast("double"), F.lit(0.0)))

    degrees = lambda p: F.when((p[1] < 60) & (p[2] < 60), p[0] + p[1] / 60 + p[2] / 3600)
    parts = F.transform(F.split(F.regexp_replace(value, r"[\[\]\s]", ""), ","), part)
    return F.when(value.rlike(DMS), F.transform(F.array(parts), degrees)[0])


def utc_offset_seconds(value: Column) -> Column:
    """Seconds of "+HH:MM" or "-HH:MM"; null if it is not one, or beyond 23:59."""
    shape = r"^\s*([+-])([0-9]{2}):([0-9]{2})\s*$"
    h, m = F.regexp_extract(value, shape, 2).cast("int"), F.regexp_extract(value, shape, 3).cast("int")
    sign = F.when(F.regexp_extract(value, shape, 1) == "-", -1).otherwise(1)
    return F.when(value.rlike(shape), F.when((h < 24) & (m < 60), sign * (h * 3600 + m * 60)))


#: White space, letters and digits as text methods know them, for patterns.
SPACE = "[" + "".join(f"\\x{{{n:x}}}" for n in range(0x3001) if chr(n).isspace()) + "]"
WORD = r"[\p{L}\p{N}_]"
BOUND = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


@cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """Characters whose case folding is one character, those, and the foldings of others."""
    folded = {chr(n): chr(n).casefold() for n in range(0x110000) if not 0xD800 <= n < 0xE000 and chr(n).casefold() != chr(n)}
    single = {c: f for c, f in folded.items() if len(f) == 1}
    return "".join(single), "".join(single.values()), {c: f for c, f in folded.items() if len(f) > 1}


def casefold(value: Column) -> Column:
    """Full case folding, as of caseless matching: ß becomes ss, ſ becomes s."""
    source, target, several = _folds()
    table = F.create_map(*(F.lit(x) for pair in several.items() for x in pair))
    single = F.translate(value, source, target)
    spelt = F.array_join(F.transform(F.split(single, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")
    return F.when(value.rlike(r"^[\x00-\x7F]*\z"), F.lower(value)).when(single.rlike("[" + "".join(several) + "]"), spelt).otherwise(single)


def normalized_text(value: Column) -> Column:
    """Case folded, hyphens and underscores as spaces, single spaces, whatever the language."""
    return F.trim(F.regexp_replace(F.translate(casefold(value), "-_", "  "), SPACE + "+", " "))


def interpret_metadata(entries: DataFrame) -> DataFrame:
    """Position and capture time of each observation, from its raw entries.

    entries has observation_id, position, namespace, key, value; only the
    namespace EXIF counts, the first value of a key wins, and a key that occurs
    twice makes what it is needed for INVALID. Returns observation_id,
    gps_status (ABSENT, INVALID, INCOMPLETE, RESOLVED), latitude_deg,
    longitude_deg, map_datum, time_status (ABSENT, INVALID, LOCAL_AMBIGUOUS,
    RESOLVED) and instant_us. What is not resolved stays null.
    """
    exif = F.col("namespace") == "EXIF"
    wanted = (*REQUIRED, DATUM, TIME, OFFSET)
    names = {k: f"k{i}" for i, k in enumerate(wanted)}
    of = {k: exif & (F.col("key") == k) for k in wanted}
    cells = [F.min(F.when(of[k], F.struct("position", "value"))).getField("value").alias(n) for k, n in names.items()]
    twice = lambda keys: F.greatest(*(F.count_if(of[k]) for k in keys)) > 1
    flags = [
        F.max(exif & F.col("key").startswith("GPS ")).alias("any_gps"),
        twice((*REQUIRED, DATUM)).alias("gps_twice"),
        F.max(exif & F.col("key").isin(TIME, OFFSET)).alias("any_time"),
        twice((TIME, OFFSET)).alias("time_twice"),
    ]
    keyed = spread(entries, entries.count(), "observation_id").groupBy("observation_id").agg(*cells, *flags)
    at = {k: F.col(n) for k, n in names.items()}
    lat_ref, lon_ref = F.upper(F.trim(at[LATITUDE_REF])), F.upper(F.trim(at[LONGITUDE_REF]))
    # each text is parsed once, here: what follows reads these columns
    read = {"la": dms_to_degrees(at[LATITUDE]) * F.when(lat_ref == "S", -1).otherwise(1), "lo": dms_to_degrees(at[LONGITUDE]) * F.when(lon_ref == "W", -1).otherwise(1), "seconds": utc_offset_seconds(at[OFFSET])}
    keyed = keyed.withColumn("read", F.transform(F.array(F.struct(*(c.alias(n) for n, c in read.items()))), lambda x: x)[0])
    lat, lon = F.col("read.la"), F.col("read.lo")
    good = lat_ref.isin("N", "S") & lon_ref.isin("E", "W") & lat.between(-90, 90) & lon.between(-180, 180)
    missing = at[REQUIRED[0]].isNull() | at[REQUIRED[1]].isNull() | at[REQUIRED[2]].isNull() | at[REQUIRED[3]].isNull()
    gps = F.when(~F.coalesce("any_gps", F.lit(False)), "ABSENT").when(F.col("gps_twice"), "INVALID").when(missing, "INCOMPLETE").when(F.coalesce(good, F.lit(False)), "RESOLVED").otherwise("INVALID")
    shape = r"^\s*[0-9]{4}:[0-9]{1,2}:[0-9]{1,2}\s+[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}\s*$"
    pieces = F.regexp_extract_all(at[TIME], F.lit("[0-9]+"), F.lit(0))
    local = F.when(at[TIME].rlike(shape), F.expr(f"try_make_timestamp_ntz({', '.join(f'cast(element_at(p, {i}) as int)' for i in range(1, 7))})"))
    offset = F.col("read.seconds")
    keyed = keyed.withColumn("p", pieces).withColumn("gps_status", gps).withColumn("local_us", F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), local))
    local_us = F.col("local_us")
    time = (
        F.when(~F.coalesce("any_time", F.lit(False)), "ABSENT")
        .when(F.col("time_twice") | local_us.isNull(), "INVALID")
        .when(at[OFFSET].isNull(), "LOCAL_AMBIGUOUS")
        .when(offset.isNull(), "INVALID")
        .otherwise("RESOLVED")
    )
    resolved = F.col("gps_status") == "RESOLVED"
    out = keyed.withColumn("time_status", time)
    return out.select(
        "observation_id",
        "gps_status",
        F.when(resolved, lat).alias("latitude_deg"),
        F.when(resolved, lon).alias("longitude_deg"),
        F.when(F.col("gps_status").isin("RESOLVED", "INCOMPLETE"), at[DATUM]).alias("map_datum"),
        "time_status",
        F.when(F.col("time_status") == "RESOLVED", local_us - offset.cast("bigint") * 1000000).alias("instant_us"),
    )


def input_classes(observations: DataFrame) -> DataFrame:
    """observation_id, input_class, evidence_kind, evidence_keys, in the order of the classes.

    observations has observation_id, kind (image or video), width, height
    (nullable) and entries, an array of (namespace, key, value). Still or video is
    observed; a width of twice the height, an aerial camera's name or a phrase in
    a key or value make a candidate.
    """
    entries = F.coalesce("entries", F.expr("cast(array() as array<struct<namespace:string,key:string,value:string>>)"))
    # each text is normalised once, here: the tests read these columns
    entry = lambda e: F.struct(F.concat(e["namespace"], F.lit(":"), e["key"]).alias("name"), e["namespace"].alias("namespace"), e["key"].alias("key"), normalized_text(e["key"]).alias("k"), normalized_text(e["value"]).alias("v"))
    observations = observations.withColumn("entries", F.transform(entries, entry))

    def keys(test: Callable[[Column], Column]) -> Column:
        return F.array_sort(F.array_distinct(F.transform(F.filter("entries", test), lambda e: e["name"])))

    def phrase(words: str) -> Callable[[Column], Column]:
        return lambda e: F.contains(e["k"], F.lit(words)) | F.contains(e["v"], F.lit(words))

    named_so = "|".join(AERIAL).replace(r"\b", BOUND)
    aerial = keys(lambda e: (casefold(e["namespace"]) == "exif") & casefold(e["key"]).isin(*CAMERA_KEYS) & e["v"].rlike(named_so))
    one = lambda order, name, kind, found: F.struct(F.lit(order).alias("n"), F.lit(name).alias("input_class"), F.lit(kind).alias("evidence_kind"), found.alias("evidence_keys"))
    observed = F.array(F.lit("observation.kind"))
    wide = F.when(F.col("width") == 2 * F.col("height"), F.array(F.lit("metadata.dimensions"))).otherwise(F.expr("cast(array() as array<string>)"))
    every = F.array(
        F.when(F.col("kind") == "image", one(0, "still", "observed", observed)).otherwise(one(1, "video", "observed", observed)),
        one(2, "equirectangular_360", "candidate", wide),
        one(3, "drone_aerial", "candidate", aerial),
        one(4, "fisheye", "candidate", keys(phrase("fisheye"))),
        one(5, "rolling_shutter", "candidate", keys(phrase("rolling shutter"))),
    )
    rows = observations.select("observation_id", F.explode(F.filter(every, lambda x: F.size(x["evidence_keys"]) > 0)).alias("x"))
    return rows.select("observation_id", F.col("x.n").alias("class_order"), "x.input_class", "x.evidence_kind", "x.evidence_keys")


def video_offsets(frames: DataFrame) -> DataFrame:
    """frames with offset_us: the exact time since the first frame of its video, a row for each frame.

    The offset of any two frames of a video is the difference of theirs, so all
    pairs are said without being made.
    """
    first = frames.groupBy("video_id").agg(F.min_by("frame_time_us", "frame_index").alias("_first"))
    return frames.join(first, "video_id").withColumn("offset_us", F.col("frame_time_us") - F.col("_first")).drop("_first")


def same_video_sync(frames: DataFrame, candidates: DataFrame) -> DataFrame:
    """video_id, index1, index2, offset_us, status of the candidate pairs (video_id, index1, index2) of one video's frames."""
    at = frames.select("video_id", "frame_index", "frame_time_us")
    one, two = (at.select("video_id", F.col("frame_index").alias(f"index{k}"), F.col("frame_time_us").alias(f"t{k}")) for k in (1, 2))
    met = candidates.select("video_id", "index1", "index2").where("index1 < index2").join(one, ["video_id", "index1"]).join(two, ["video_id", "index2"])
    return met.select("video_id", "index1", "index2", (F.col("t2") - F.col("t1")).alias("offset_us"), F.lit("SUPPORTED").alias("status"))


def capture_time_sync(pairs: DataFrame, times: DataFrame) -> DataFrame:
    """id1, id2, status, offset_us of pairs by their interpreted capture times.

    Two absent times make no row; two resolved ones a SUPPORTED offset; all else is UNRESOLVED without one.
    """
    one = times.select(F.col("observation_id").alias("id1"), F.col("time_status").alias("s1"), F.col("instant_us").alias("t1"))
    two = times.select(F.col("observation_id").alias("id2"), F.col("time_status").alias("s2"), F.col("instant_us").alias("t2"))
    joined = pairs.select("id1", "id2").join(one, "id1").join(two, "id2").where("not (s1 = 'ABSENT' and s2 = 'ABSENT')")
    both = (F.col("s1") == "RESOLVED") & (F.col("s2") == "RESOLVED")
    return joined.select("id1", "id2", F.when(both, "SUPPORTED").otherwise("UNRESOLVED").alias("status"), F.when(both, F.col("t2") - F.col("t1")).alias("offset_us"))


def visual_event_sync(candidates: DataFrame, least_support: int, most_residual_us: int) -> DataFrame:
    """status and offset of visual-event hypotheses: SUPPORTED if unique, with enough support and little residual."""
    good = F.coalesce(F.col("is_unique") & (F.col("support") >= least_support) & (F.col("residual_us") <= most_residual_us), F.lit(False))
    return candidates.withColumn("status", F.when(good, "SUPPORTED").otherwise("UNRESOLVED")).withColumn("offset_us", F.when(good, F.col("offset_us")))

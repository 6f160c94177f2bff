"""Names, keys and times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: 2026-08-02T00:00:00Z, to which camera offsets are relative.
BASE_EPOCH = 1785628800
#: Detector classes that are vehicles.
CLASSES = {2: "car", 3: "motorcycle", 5: "bus", 7: "truck"}


def iso_time(seconds: Column) -> Column:
    """An offset in seconds as ISO 8601 in UTC; microseconds only where there are any."""
    micros = F.lit(BASE_EPOCH * 1_000_000) + F.bround(seconds * 1_000_000, 0).cast("long")
    ts = F.timestamp_micros(micros)
    part = F.when(micros % 1_000_000 == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad((micros % 1_000_000).cast("string"), 6, "0")))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), part, F.lit("+00:00"))


def asked_camera(name: Column) -> Column:
    """cam_N from clipN names, as questions name cameras; other names without their ending."""
    number = F.regexp_extract(name, r"clip(\d+)", 1)
    return F.when(number != "", F.concat(F.lit("cam_"), number)).otherwise(F.regexp_replace(name, r"\.\w+$", ""))


#: How flat crop files name their track.
TRACK_FILE = r"^([a-zA-Z0-9_.]+\.mp4_\d+|[a-zA-Z0-9_.]+\.avi_\d+|clip\d+\.mp4_\d+|c\d+_\d+)"


def track_of_file(name: Column) -> Column:
    """The track of a flat crop file: by its form, else what is before ``_frame_`` or the ending."""
    own = F.regexp_extract(name, TRACK_FILE, 1)
    before = F.when(F.contains(name, F.lit("_frame_")), F.substring_index(name, "_frame_", 1)).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))
    return F.when(own != "", own).otherwise(before)


def clock(seconds: Column) -> Column:
    """HH:MM:SS of an offset in seconds."""
    whole = F.floor(seconds).cast("long")
    return F.concat_ws(":", *(F.lpad(part.cast("string"), 2, "0") for part in (F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)))


def camera_id(clip: Column) -> Column:
    """The forms of camera names. c001 from names that hold it, c%03d from clipN, else the name without its ending."""
    stem = F.regexp_replace(clip, r"\.(mp4|avi)$", "")
    own, number = F.regexp_extract(stem, r"(c\d{3}|c\d+)", 1), F.regexp_extract(stem, r"clip(\d+)", 1)
    numbered = F.concat(F.lit("c"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number))
    return F.when(own != "", own).when(number != "", numbered).otherwise(stem)


def normal_camera(name: Column) -> Column:
    """cam_N for digits, else lower case with underscores."""
    bare = F.trim(name)
    return F.when(bare.rlike(r"^\d+$"), F.concat(F.lit("cam_"), bare)).otherwise(F.regexp_replace(F.lower(bare), r"\s+", "_"))


def track_key_parts(key: Column) -> tuple[Column, Column]:
    """Feed and track of feed_track; feeds may hold underscores."""
    track = F.substring_index(key, "_", -1)
    return F.substring(key, F.lit(1), F.length(key) - F.length(track) - 1), track


def class_name(class_id: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in CLASSES.items() for x in pair))
    return F.coalesce(F.element_at(known, class_id), F.lit("unknown"))


def crop_fields(name: Column, fps: float = 30.0) -> tuple[Column, Column]:
    """The form of crop names. Frame and time of frame_000012_t3.50 names; the time else follows from the frame."""
    frame = F.coalesce(F.regexp_extract(name, r"frame_(\d+)", 1).try_cast("int"), F.lit(-1))
    time = F.regexp_extract(name, r"_t(\d+(?:\.\d+)?)", 1).try_cast("double")
    return frame, F.coalesce(time, F.when(frame >= 0, frame / fps), F.lit(0.0))


def stable_id(text: Column, most: int = 10_000_000) -> Column:
    """A number below ``most`` that every run gives alike."""
    return F.pmod(F.xxhash64(text), F.lit(most))


def model_by_dimension(dim: Column) -> Column:
    """The models that make vectors of these sizes."""
    return F.when(dim == 768, "clip-vit-large").when(dim == 512, "clip-vit-base").when(dim == 1152, "siglip2").otherwise("default")

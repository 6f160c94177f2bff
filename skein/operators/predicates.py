"""Filters from nested dictionaries, and from questions in plain words."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {
    "gte": lambda c, v: c >= v, "lte": lambda c, v: c <= v, "gt": lambda c, v: c > v, "lt": lambda c, v: c < v, "eq": lambda c, v: c == v,
    ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, "<": lambda c, v: c < v, "=": lambda c, v: c == v,
}
RENAMED = {"camera_timestamp": "camera_timestamp_sec"}


def compile_where(where: dict | None, renamed: dict[str, str] = RENAMED) -> Column:
    """A conjunction: {field: value}, {field: {"$gte": v}}, {"$and": [...]}; unknown operators are ignored."""
    terms: list[Column] = []
    for name, value in (where or {}).items():
        if name == "$and":
            terms += [compile_where(part, renamed) for part in value]
        elif isinstance(value, dict):
            column = F.col(renamed.get(name, name))
            terms += [_COMPARE[op.lstrip("$")](column, v) for op, v in value.items() if op.lstrip("$") in _COMPARE]
        else:
            terms.append(F.col(renamed.get(name, name)) == F.lit(value))
    return reduce(lambda a, b: a & b, terms, F.lit(True))


@dataclass
class Question:
    """What is left of the words, the filters found, and the words' day if one was named."""

    text: str
    filters: dict = field(default_factory=dict)


#: Hours of the named parts of a day; the night ends with its day.
DAY_PARTS = {"morning": (6, 12), "afternoon": (12, 17), "evening": (17, 21), "night": (21, 24)}
_CLOCK = r"(\d{1,2})(?::(\d{2}))?\s*(am|pm)?"
#: Words that a question loses besides its filters.
_FILLERS = re.compile(r"\b(?:at|on|from|in|during|show|find|all|the)\b", re.I)


def _hours(hour: str, minute: str | None, half: str | None) -> float:
    h = int(hour) % 12 + (12 if half.lower() == "pm" else 0) if half else int(hour)
    return min(24.0, h + int(minute or 0) / 60)


def parse_question(question: str, now: datetime | None = None) -> Question:
    """Camera, day and time filters of a question, as epoch seconds; the rest stays as text.

    A camera needs a digit or a separator, so "the camera" and "camel" name none. Both ends of
    "between 9am and 5pm" keep their own half of the day, and hour 24 is the next midnight.
    """
    now = now or datetime.now(timezone.utc)
    found, spans = Question(question), []

    def take(pattern: str) -> re.Match | None:
        m = re.search(pattern, question, re.I)
        if m:
            spans.append(m.span())
        return m

    if m := take(r"\b(?:camera|cam)(?:\s*[_-]\s*|\s+(?=\w*\d)|(?=\d))(\w+)\b"):
        found.filters["camera_id"] = f"cam_{m[1]}" if m[1].isdigit() else m[1].lower()
    elif m := take(r"\bgate\s*(\d\w*)\b"):
        found.filters["camera_id"] = f"gate{m[1].lower()}"
    day = now.replace(hour=0, minute=0, second=0, microsecond=0)
    dated = False
    if m := take(r"\byesterday\b"):
        day, dated = day - timedelta(days=1), True
    elif m := take(r"\btoday\b"):
        dated = True
    start, end = (day, day + timedelta(days=1)) if dated else (None, None)
    at = lambda hours: day + timedelta(hours=hours)
    if m := take(r"\blast\s+(\d+)\s+(minute|hour)s?\b"):
        start, end = now - timedelta(**{f"{m[2].lower()}s": int(m[1])}), now
    elif m := take(rf"\bbetween\s+{_CLOCK}\s+and\s+{_CLOCK}\b"):
        start, end = at(_hours(m[1], m[2], m[3] or m[6])), at(_hours(m[4], m[5], m[6]))
    elif m := take(r"\b(before|after)\s+noon\b"):
        start, end = (at(0), at(12)) if m[1].lower() == "before" else (at(12), at(24))
    elif m := take(rf"\bafter\s+{_CLOCK}\b"):
        start, end = at(_hours(m[1], m[2], m[3])), at(24)
    elif m := take(rf"\bbefore\s+{_CLOCK}\b"):
        start, end = at(0), at(_hours(m[1], m[2], m[3]))
    elif m := take(r"\b(morning|afternoon|evening|night)\b"):
        found.filters["time_of_day"] = m[1].lower()
        if dated:
            start, end = (at(h) for h in DAY_PARTS[m[1].lower()])
    if start is not None:
        found.filters["camera_timestamp"] = {"$gte": start.timestamp(), "$lt": end.timestamp()}
    if spans:
        text = question
        for a, b in sorted(spans, reverse=True):
            text = text[:a] + " " + text[b:]
        found.text = " ".join(_FILLERS.sub(" ", text).split())
    return found


def question_filter(question: Question, camera: str | None = None, base_epoch: float = 0.0) -> Column:
    """The filters as a column; ``camera`` overrides, times are relative to ``base_epoch``."""
    where = {k: v for k, v in question.filters.items() if k != "time_of_day"}
    if camera:
        where["camera_id"] = camera
    if "camera_timestamp" in where:
        where["camera_timestamp"] = {op: v - base_epoch for op, v in where["camera_timestamp"].items()}
    return compile_where(where)


# Small filters of rows


def detected(classes: list[int], least: float = 0.25) -> Column:
    """Detections of the classes, sure enough; of every class for none."""
    sure = F.col("score") >= least
    return sure & F.col("class_id").isin(classes) if classes else sure


def large_enough(width: float, height: float, share: float = 0.0) -> Column:
    """Boxes that take more than a share of the frame."""
    return (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) / (width * height) > share


def up_to_frame(most: int | None) -> Column:
    """Frames up to a number; all without one."""
    return F.lit(True) if most is None else F.col("frame") <= most


def confirmed() -> Column:
    """Tracks that were ever activated."""
    return F.coalesce(F.col("is_activated"), F.lit(False))


def among(column: str, wanted: list) -> Column:
    """Rows of the wanted values; every row for none."""
    return F.col(column).isin(wanted) if wanted else F.lit(True)

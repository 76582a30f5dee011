"""Column expressions that turn raw identifiers, names, dates and amounts into canonical values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The types of the data model, honorifics, list separators, status words, social interactions and date formats.
NODE_TYPES = ("person", "phone", "organization", "location", "vehicle", "account", "device", "event", "document")
EDGE_TYPES = ("CALLED", "MESSAGED", "TRANSFERRED_TO", "CO_OCCURS", "OWNS", "LOCATED_AT", "REGISTERED_TO", "MENTIONED_IN")
TITLES = ("mr", "mrs", "ms", "miss", "shri", "smt", "sh", "sri", "dr", "kum", "late")
LIST_SEPARATOR = r"(?i)\s*[;,|/]\s*|\s+and\s+"
CONVICTED = ("convict", "guilty", "sentenc")
ACQUITTED = ("acquit", "discharg", "closed", "cancel", "untrac")
PENDING = ("pend", "trial", "investigat", "open", "chargesheet")
#: word in the interaction -> edge type, weight, confidence, basis; the first that occurs counts.
INTERACTIONS = (
    ("dm", "MESSAGED", 1.0, 0.90, "social_dm"),
    ("message", "MESSAGED", 1.0, 0.90, "social_dm"),
    ("chat", "MESSAGED", 1.0, 0.90, "social_dm"),
    ("reply", "MESSAGED", 0.6, 0.85, "social_reply"),
    ("comment", "MESSAGED", 0.6, 0.85, "social_reply"),
    ("mention", "CO_OCCURS", 0.3, 0.80, "social_mention"),
    ("tag", "CO_OCCURS", 0.3, 0.80, "social_mention"),
    ("post", "CO_OCCURS", 0.3, 0.80, "social_mention"),
    ("follow", "CO_OCCURS", 0.2, 0.85, "social_follow"),
    ("friend", "CO_OCCURS", 0.2, 0.85, "social_follow"),
    ("connect", "CO_OCCURS", 0.2, 0.85, "social_follow"),
)
OTHER_INTERACTION = ("CO_OCCURS", 0.2, 0.5, "social_unspecified")
#: Dates as year-month-day, day/month/year or day-month-year, unpadded numbers accepted, with hours, minutes and seconds, with hours and minutes, or without; day-Mon-year.
NUMERIC = r"^\d{4}-\d{1,2}-\d{1,2}(?:[T ]\d{1,2}:\d{1,2}:\d{1,2})?$"
NAMED_MONTHS = (
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4} \d{1,2}:\d{1,2}$", "d-MMM-yyyy H:m"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4} \d{1,2}:\d{1,2}$", "d MMM yyyy H:m"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
)
#: ISO texts with a fraction or a zone; their zone counts.
ISO_WITH_ZONE = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slug(value: Column | str) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(value))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def person(value: Column | str) -> Column:
    """Slug without leading honorifics."""
    return F.regexp_replace(slug(value), f"^(?:(?:{'|'.join(TITLES)})(?:_|$))+", "")


def phone(value: Column | str) -> Column:
    """Ten-digit mobiles, under any prefix, as 91 and ten digits; anything else as its digits."""
    digits = F.regexp_replace(col(value), r"\D", "")
    bare = F.regexp_replace(digits, r"^(?:091|91|0)(\d{10})$", "$1")
    return F.regexp_replace(bare, r"^([6-9]\d{9})$", "91$1")


def plate(value: Column | str) -> Column:
    """Vehicles and devices without separators."""
    return F.regexp_replace(F.lower(F.trim(col(value))), "[^a-z0-9]+", "")


def node_id(type_: Column | str, value: Column | str) -> Column:
    """`{type}:{normalised value}`; null for an unknown type or a value that normalises to nothing."""
    normal = {"person": person, "phone": phone, "vehicle": plate, "device": plate}
    if isinstance(type_, str):
        prefix = {"document": "doc"}.get(type_, type_) if type_ in NODE_TYPES else None
        return F.concat(F.lit(prefix).cast("string"), F.lit(":"), F.nullif(normal.get(type_, slug)(value), F.lit("")))
    norm = F.when(type_ == "person", person(value)).when(type_ == "phone", phone(value)).when(type_.isin("vehicle", "device"), plate(value)).otherwise(slug(value))
    prefix = F.when(type_ == "document", F.lit("doc")).when(type_.isin(*NODE_TYPES), type_)
    return F.concat(prefix, F.lit(":"), F.nullif(norm, F.lit("")))


def type_of(id_: Column | str) -> Column:
    """The type an id names; null if it names none."""
    prefix = F.substring_index(col(id_), ":", 1)
    return F.when(prefix == "doc", F.lit("document")).when(prefix.isin(*NODE_TYPES), prefix)


def header(name: str) -> str:
    """A column name in lower case with white space and dashes as underscores."""
    return reduce(lambda s, c: s.replace(c, "_"), " \t-", " ".join(name.strip().lower().split()))


def pick(columns: dict[str, str], aliases: tuple[str, ...]) -> Column:
    """The first alias with a value; ``columns`` maps normalised headers to column names."""
    found = [F.nullif(F.trim(F.col(f"`{columns[a]}`")), F.lit("")) for a in aliases if a in columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def timestamp(raw: Column | str) -> Column:
    """The first format that fits; null, never now, for what fits none.

    A failed parse costs far more than a pattern: numeric dates are turned to year, month, day and cast once, and only names of months go through a format.
    """
    text = F.trim(col(raw))
    ymd = F.regexp_replace(text, r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4})(?= |$)", "$4-$3-$1")
    ymd = F.regexp_replace(ymd, r"^(\S+ \d{1,2}:\d{1,2})$", "$1:00")
    out = F.when(ymd.rlike(NUMERIC), ymd.try_cast("timestamp")).when(text.rlike(ISO_WITH_ZONE), text.try_cast("timestamp"))
    for pattern, f in NAMED_MONTHS:
        out = out.when(text.rlike(pattern), F.try_to_timestamp(text, F.lit(f)))
    return out


def amount(raw: Column | str) -> Column:
    """The number in a text; a leading currency word such as `Rs.` is taken off first."""
    bare = F.regexp_replace(col(raw), r"^\s*[A-Za-z]+\.?\s*", "")
    return F.regexp_replace(bare, r"[^\d.\-]", "").try_cast("double")


def _has_any(low: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (low.contains(w) for w in words))


def disposition(status: Column | str) -> Column:
    """Convicted, acquitted, pending, or null for what says neither."""
    low = F.lower(F.trim(col(status)))
    return F.when(_has_any(low, CONVICTED), "convicted").when(_has_any(low, ACQUITTED), "acquitted").when(_has_any(low, PENDING), "pending")


def split_list(raw: Column | str) -> Column:
    """X11: the parts of a list written with ; , / | or `and`."""
    return F.filter(F.transform(F.split(F.coalesce(col(raw), F.lit("")), LIST_SEPARATOR), lambda x: F.trim(x)), lambda x: x != "")


def interaction(kind: Column | str) -> Column:
    """struct(type, weight, confidence, basis) of a social interaction."""
    low = F.lower(F.coalesce(col(kind), F.lit("")))
    as_struct = lambda t, w, c, b: F.struct(F.lit(t).alias("type"), F.lit(w).alias("weight"), F.lit(c).alias("confidence"), F.lit(b).alias("basis"))
    out = as_struct(*OTHER_INTERACTION)
    for word, *rest in reversed(INTERACTIONS):
        out = F.when(low.contains(word), as_struct(*rest)).otherwise(out)
    return out


def best_label(type_: Column | str, label: Column | str, seq: Column | str) -> Column:
    """X13, an aggregate: identifiers with the least punctuation, then the longest; names the longest; ties the earliest."""
    label = col(label)
    noise = F.length(F.regexp_replace(label, r"[\p{L}\p{N}]", ""))
    plain = F.when(col(type_).isin("phone", "account", "vehicle", "device"), noise).otherwise(F.lit(0))
    return F.min_by(label, F.struct(plain.alias("p"), (-F.length(label)).alias("l"), col(seq).alias("s")))


def valid_case_id(id_: Column | str) -> Column:
    """X15."""
    return F.coalesce(col(id_).rlike(r"^[a-z0-9][a-z0-9_\-]{0,63}$"), F.lit(False))


def canonical_json(**fields: Column) -> Column:
    """Keys in order, no spaces, nulls kept."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in sorted(fields.items()))), {"ignoreNullFields": "false"})


def plural(n: Column, word: str) -> Column:
    """`1 contact`, `2 contacts`."""
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))

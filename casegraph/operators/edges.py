"""Record tables to typed edge facts.

Every job takes a raw table of strings with case_id, doc_id, seq (arrival order) and, if :func:`casegraph.sources.tables.record_lines` read it, the span
of each row (start, end). It returns edge facts:
case_id, src, dst, type, ts, weight, confidence, amount, duration_sec, basis, offence, disposition, attrs, doc_id, seq, start, end.
A table is scanned once: ids are computed once a row, and each row explodes to the facts it holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph.functions import normalize as N

# Accepted column names in order of preference, and the confidence of each kind of fact.
CALL_COLUMNS = {
    "caller": ("caller", "a_party", "calling_number", "from", "msisdn", "caller_number"),
    "callee": ("callee", "b_party", "called_number", "to", "receiver", "callee_number"),
    "ts": ("ts", "timestamp", "datetime", "date_time", "call_time", "start_time", "date"),
    "duration": ("duration", "duration_sec", "duration_seconds", "dur"),
    "call_type": ("call_type", "type", "cdr_type", "service"),
    "imei": ("imei", "imei_a", "caller_imei", "handset"),
    "tower": ("tower", "cell_id", "cell_site", "site_id", "location", "cgi"),
    "subscriber": ("subscriber", "caller_name", "a_party_name", "registered_to"),
}
TRANSFER_COLUMNS = {
    "src": ("from_account", "remitter_account", "debit_account", "from", "payer_account"),
    "dst": ("to_account", "beneficiary_account", "credit_account", "to", "payee_account"),
    "amount": ("amount", "amt", "value", "transaction_amount"),
    "ts": ("ts", "timestamp", "datetime", "date", "txn_date", "value_date"),
    "txn_id": ("txn_id", "transaction_id", "reference", "ref_no", "utr"),
    "mode": ("mode", "channel", "type", "txn_type"),
    "holder": ("holder", "account_holder", "remitter", "remitter_name", "payer_name"),
    "payee": ("payee", "beneficiary", "beneficiary_name", "payee_name"),
    "ifsc": ("ifsc", "ifsc_code", "beneficiary_ifsc"),
}
SOCIAL_COLUMNS = {
    "platform": ("platform", "network", "site", "source_platform", "app"),
    "handle": ("handle", "username", "user", "screen_name", "from_handle", "author", "profile", "account", "from", "source_handle"),
    "target": ("to_handle", "target_handle", "target", "peer", "mentioned", "mentions", "in_reply_to", "reply_to", "follows", "followed", "to", "with"),
    "interaction": ("interaction", "action", "relation", "event", "type", "activity"),
    "display": ("display_name", "name", "full_name", "real_name", "profile_name"),
    "ts": ("ts", "timestamp", "datetime", "date", "posted_at", "created_at", "time"),
    "location": ("location", "place", "geo", "geotag", "checkin"),
    "text": ("text", "content", "message", "post", "body", "caption"),
    "url": ("url", "link", "permalink", "post_url", "profile_url"),
}
HISTORY_COLUMNS = {
    "person": ("person", "name", "accused", "accused_name", "offender", "suspect", "subject", "full_name", "offender_name"),
    "case_no": ("case_no", "case_number", "fir_no", "fir_number", "crime_no", "cr_no", "rc_no", "case_id", "fir"),
    "offence": ("offence", "offense", "section", "sections", "ipc_section", "act", "charge", "crime_head", "under_section"),
    "ts": ("date", "ts", "date_of_offence", "registration_date", "incident_date", "timestamp", "year", "fir_date"),
    "station": ("police_station", "ps", "station", "thana", "jurisdiction"),
    "status": ("status", "disposal", "case_status", "outcome", "result", "verdict"),
    "co_accused": ("co_accused", "coaccused", "associates", "other_accused", "accomplices"),
    "court": ("court", "court_name", "trial_court"),
    "role": ("role", "involvement", "accused_role"),
}
RECORD, TOWER, SOCIAL_OWNS, GEOTAG, CO_ACCUSED = 0.95, 0.9, 0.45, 0.7, 0.85
PROVENANCE, SPAN = ("case_id", "doc_id", "seq"), ("start", "end")
EXCERPT = 200
#: The fields of a fact besides its ends and where it stands.
FIELDS = {"type": "string", "weight": "double", "confidence": "double", "ts": "timestamp", "amount": "double", "duration_sec": "double", "basis": "string", "offence": "string", "disposition": "string", "attrs": "map<string,string>"}
#: What :func:`ingest_all` returns.
FOUND = {"case_id": "string", "src": "string", "dst": "string", **FIELDS, "label": "string", "doc_id": "string", "seq": "long", "start": "int", "end": "int", "place": "int"}


def canonical(raw: DataFrame, columns: dict[str, tuple[str, ...]]) -> DataFrame:
    """R2: one typed column for each field, from whichever accepted name the table has; ts and amount parsed, bad ones null."""
    have = {N.header(c): c for c in raw.columns if c not in (*PROVENANCE, *SPAN)}
    span = [(F.col(c) if c in raw.columns else F.lit(None)).cast("int").alias(c) for c in SPAN]
    out = raw.select(*PROVENANCE, *span, *(N.pick(have, aliases).alias(k) for k, aliases in columns.items()))
    if "ts" in columns:
        out = out.withColumn("raw_ts", F.col("ts")).withColumn("ts", N.timestamp("raw_ts"))
    for c in {"amount", "duration"} & set(columns):
        out = out.withColumn(f"raw_{c}", F.col(c)).withColumn(c, N.amount(f"raw_{c}"))
    return out


def quality(table: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """R2: rows read, rows without a required field, dates and amounts that did not parse, by document."""
    missing = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in required))
    bad = lambda c: F.count_if(F.col(f"raw_{c}").isNotNull() & F.col(c).isNull()) if f"raw_{c}" in table.columns else F.lit(0)
    return table.groupBy("case_id", "doc_id").agg(
        F.count(F.lit(1)).alias("rows_read"), F.count_if(missing).alias("rows_dropped"), bad("ts").alias("bad_dates"), bad("amount").alias("bad_amounts")
    )


def fact(src: Column, dst: Column, type_: Column | str, *, weight: float | Column = 1.0, confidence: float | Column = RECORD, **extra: Column) -> Column:
    """An edge fact as a struct."""
    return _found(src, dst, {"type": type_, "weight": weight, "confidence": confidence, **extra})


def sighting(id_: Column, label: Column, **told: Column) -> Column:
    """A node as a row names it, in the form of a fact without a second end: its id, the text it was read from, attributes."""
    return _found(id_, F.lit(None).cast("string"), {"label": F.trim(label), **({"attrs": attrs(**told)} if told else {})})


def _found(src: Column, dst: Column, given: dict) -> Column:
    value = lambda k: given[k] if isinstance(given.get(k), Column) else F.lit(given.get(k))
    return F.struct(src.alias("src"), dst.alias("dst"), *(value(k).cast(t).alias(k) for k, t in FIELDS.items()), value("label").cast("string").alias("label"))


def emit(table: DataFrame, found: Column) -> DataFrame:
    """The facts each row holds; those with a missing end or both ends the same go. An outer explode, as for a plain one Spark computes the array once more to drop empty ones first."""
    out = table.select(*PROVENANCE, *SPAN, F.explode_outer(found).alias("f")).select("case_id", "f.*", "doc_id", "seq", *SPAN).drop("label")
    return out.filter("src is not null and dst is not null and src <> dst")


def emit_all(table: DataFrame, seen: Column, found: Column) -> DataFrame:
    """The sightings and facts of each row from one explode, ``place`` telling their order in the row. A sighting has a label and no dst."""
    out = table.select(*PROVENANCE, *SPAN, F.posexplode_outer(F.concat(seen, found)).alias("place", "f")).select("case_id", "f.*", "doc_id", "seq", *SPAN, "place")
    return out.filter("src is not null and (label is not null or (dst is not null and src <> dst))")


def attrs(**values: Column) -> Column:
    """A map of the values that are there; null if none is."""
    pairs = F.array(*(F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))) for k, v in values.items()))
    return F.when(reduce(lambda a, b: a | b, (v.isNotNull() for v in values.values())), F.map_from_entries(F.array_compact(pairs)))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _calls(raw: DataFrame) -> tuple[DataFrame, Column, Column]:
    t = canonical(raw, CALL_COLUMNS).withColumns({"x": N.node_id("phone", "caller"), "y": N.node_id("phone", "callee"), "tower_id": N.node_id("location", "tower"), "device": N.node_id("device", "imei"), "holder": N.node_id("person", "subscriber")})
    kind = F.coalesce(F.lower("call_type"), F.lit("call"))
    t = t.withColumns({"phone": F.when(F.col("x") != F.col("y"), F.col("x")), "kind": kind, "both": F.col("caller").isNotNull() & F.col("callee").isNotNull()})
    phone = F.col("phone")
    linked = lambda c: F.when(phone.isNotNull(), F.col(c))
    seen = F.array(
        sighting(F.when(F.col("both"), F.col("x")), F.col("caller")),
        sighting(F.when(F.col("both"), F.col("y")), F.col("callee")),
        sighting(linked("device"), F.col("imei")),
        sighting(linked("tower_id"), F.col("tower"), kind=F.lit("cell_tower")),
        sighting(linked("holder"), F.col("subscriber")),
    )
    return t, seen, F.array(
        fact(phone, F.col("y"), F.when(F.col("kind").rlike("^(?:sms|msg|text)"), "MESSAGED").otherwise("CALLED"), ts=F.col("ts"), duration_sec=F.col("duration"), attrs=attrs(call_type=F.col("kind"), tower=F.col("tower"))),
        fact(F.col("device"), phone, "REGISTERED_TO", basis="cdr_handset"),
        fact(phone, F.col("tower_id"), "LOCATED_AT", confidence=TOWER, ts=F.col("ts"), basis="cdr_tower"),
        fact(F.col("holder"), phone, "OWNS", basis="subscriber_record"),
    )


def calls(raw: DataFrame) -> DataFrame:
    """Calls and messages, handsets, towers, subscribers."""
    t, _, found = _calls(raw)
    return emit(t, found)


def _transfers(raw: DataFrame) -> tuple[DataFrame, Column, Column]:
    t = canonical(raw, TRANSFER_COLUMNS).withColumns({"x": N.node_id("account", "src"), "y": N.node_id("account", "dst"), "a": N.node_id("person", "holder"), "b": N.node_id("person", "payee")})
    t = t.withColumns({"linked": F.coalesce(F.col("x") != F.col("y"), F.lit(False)), "both": F.col("src").isNotNull() & F.col("dst").isNotNull()})
    src, dst = (F.when(F.col("linked"), F.col(c)) for c in ("x", "y"))
    seen = F.array(
        sighting(F.when(F.col("both"), F.col("x")), F.col("src")),
        sighting(F.when(F.col("both"), F.col("y")), F.col("dst"), ifsc=F.col("ifsc")),
        sighting(F.when(F.col("linked"), F.col("a")), F.col("holder")),
        sighting(F.when(F.col("linked"), F.col("b")), F.col("payee")),
    )
    return t, seen, F.array(
        fact(src, dst, "TRANSFERRED_TO", ts=F.col("ts"), amount=F.col("amount"), attrs=attrs(mode=F.col("mode"), txn_id=F.col("txn_id"))),
        fact(F.col("a"), src, "OWNS", basis="bank_record"),
        fact(F.col("b"), dst, "OWNS", basis="bank_record"),
    )


def transfers(raw: DataFrame) -> DataFrame:
    """Transfers, and the holders both sides name."""
    t, _, found = _transfers(raw)
    return emit(t, found)


def account_attrs(raw: DataFrame) -> DataFrame:
    """E5: the branch codes that transfers give for the accounts they go to, as (case_id, id, key, value, doc_id, seq) for the merge of node attributes."""
    t = canonical(raw, TRANSFER_COLUMNS).select("case_id", N.node_id("account", "dst").alias("id"), F.lit("ifsc").alias("key"), F.col("ifsc").alias("value"), "doc_id", "seq")
    return t.filter("id is not null and value is not null")


def handle_name(handle: Column) -> Column:
    return F.regexp_replace(F.trim(handle), "^@+", "")


def handle_id(platform: Column, handle: Column) -> Column:
    """Accounts of a platform, whatever the spelling of the handle."""
    name = N.slug(handle_name(handle))
    place = F.coalesce(F.nullif(N.slug(platform), F.lit("")), F.lit("social"))
    return F.concat(F.lit("account:"), place, F.lit("_"), F.nullif(name, F.lit("")))


def _social(raw: DataFrame) -> tuple[DataFrame, Column, Column]:
    t = canonical(raw, SOCIAL_COLUMNS).withColumns({"me": handle_id(F.col("platform"), F.col("handle")), "x": N.interaction("interaction"), "site": F.coalesce(F.nullif(N.slug("platform"), F.lit("")), F.lit("social"))})
    t = t.withColumns({"who": F.when(F.col("me").isNotNull(), N.node_id("person", "display")), "where": F.when(F.col("me").isNotNull(), N.node_id("location", "location"))})
    loose, me = F.col("x.type") == "CO_OCCURS", F.col("me")
    told = attrs(platform=F.col("site"), interaction=F.lower("interaction"), url=F.col("url"), excerpt=F.substring("text", 1, EXCERPT))
    handle = lambda id_, name, **more: sighting(id_, F.concat(F.lit("@"), handle_name(name)), kind=F.lit("social_handle"), platform=F.col("site"), handle=handle_name(name), **more)

    def met(name: Column) -> Column:
        peer = handle_id(F.col("platform"), name)
        src, dst = F.when(loose, F.least(me, peer)).otherwise(me), F.when(loose, F.greatest(me, peer)).otherwise(peer)
        return fact(F.when(me.isNotNull() & peer.isNotNull(), src), dst, F.col("x.type"), weight=F.col("x.weight"), confidence=F.col("x.confidence"), ts=F.col("ts"), basis=F.col("x.basis"), attrs=told)

    own = F.array(
        fact(F.col("who"), me, "OWNS", confidence=SOCIAL_OWNS, basis="social_profile", attrs=attrs(platform=F.col("site"), display_name=F.col("display"))),
        fact(me, F.col("where"), "LOCATED_AT", confidence=GEOTAG, ts=F.col("ts"), basis="social_geotag"),
    )
    seen = F.array(
        handle(me, F.col("handle"), profile_url=F.col("url")), sighting(F.col("who"), F.col("display")), sighting(F.col("where"), F.col("location"), kind=F.lit("social_geotag"))
    )
    peers = F.transform(N.split_list("target"), lambda name: handle(F.when(me.isNotNull(), handle_id(F.col("platform"), name)), name))
    return t, F.concat(seen, peers), F.concat(own, F.transform(N.split_list("target"), met))


def social(raw: DataFrame) -> DataFrame:
    """Interactions with each listed target, display names, geotags."""
    t, _, found = _social(raw)
    return emit(t, found)


def _history(raw: DataFrame) -> tuple[DataFrame, Column, Column]:
    t = canonical(raw, HISTORY_COLUMNS).withColumns({"x": N.node_id("person", "person"), "y": N.node_id("event", "case_no"), "outcome": N.disposition("status"), "where": N.node_id("location", "station")})
    both, given = F.col("x").isNotNull() & F.col("y").isNotNull(), F.col("person").isNotNull() & F.col("case_no").isNotNull()
    who, prior = F.when(both, F.col("x")), F.when(both, F.col("y"))
    told = {"ts": F.col("ts"), "offence": F.col("offence")}

    def beside(name: Column) -> Column:
        other = N.node_id("person", name)
        # Null, as a fact without an end, where there is no other; least and greatest skip nulls.
        met = F.when(both & (other != F.col("x")), other)
        return F.array(
            fact(met, prior, "MENTIONED_IN", basis="criminal_history", disposition=F.col("outcome"), attrs=attrs(role=F.lit("co-accused"), status=F.col("status")), **told),
            fact(F.when(met.isNotNull(), F.least(F.col("x"), other)), F.when(met.isNotNull(), F.greatest(F.col("x"), other)), "CO_OCCURS", confidence=CO_ACCUSED, basis="co_accused", attrs=attrs(case=prior, status=F.col("status")), **told),
        )

    own = F.array(
        fact(who, prior, "MENTIONED_IN", basis="criminal_history", disposition=F.col("outcome"), attrs=attrs(role=F.col("role"), status=F.col("status"), court=F.col("court")), **told),
        fact(prior, F.col("where"), "LOCATED_AT", basis="case_jurisdiction", ts=F.col("ts")),
    )
    number = F.when(F.col("case_no").rlike("^[0-9]"), F.concat(F.lit("Case "), F.col("case_no"))).otherwise(F.col("case_no"))
    seen = F.array(
        sighting(F.when(given, F.col("x")), F.col("person")),
        sighting(
            F.when(given, F.col("y")), number, kind=F.lit("prior_case"), offence=F.col("offence"), status=F.col("status"), disposition=F.col("outcome"), station=F.col("station"), court=F.col("court"),
            ts=F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
        ),
        sighting(F.when(both, F.col("where")), F.col("station"), kind=F.lit("police_station")),
    )
    others = F.transform(N.split_list("co_accused"), lambda name: sighting(F.when(both, N.node_id("person", name)), name))
    return t, F.concat(seen, others), F.concat(own, F.flatten(F.transform(N.split_list("co_accused"), beside)))


def history(raw: DataFrame) -> DataFrame:
    """Prior cases, their stations, and those accused together."""
    t, _, found = _history(raw)
    return emit(t, found)


#: The job for each kind of table.
JOBS = {"cdr": calls, "financial": transfers, "social": social, "history": history}
_FOUND = {"cdr": _calls, "financial": _transfers, "social": _social, "history": _history}


def ingest(tables: dict[str, DataFrame]) -> DataFrame:
    """The edge facts of raw tables by kind; kinds without a job have none."""
    return union(*(JOBS[kind](raw) for kind, raw in tables.items() if kind in JOBS))


def ingest_all(tables: dict[str, DataFrame]) -> DataFrame | None:
    """Facts and, as rows without a dst, sightings of nodes with the text they were read from; each table is scanned once. Nothing for kinds without a job."""
    parts = [emit_all(*_FOUND[kind](raw)) for kind, raw in tables.items() if kind in _FOUND]
    return union(*parts) if parts else None

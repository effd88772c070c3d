"""Values that come in several shapes: addresses and officers as objects, lists or text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnlake.functions.text import address_key, address_line, person_name

_PARTS = ("line1", "line2", "city", "state", "zip")


def address_text(c: Column) -> Column:
    """One line from an address that is a JSON object with line1, line2, city, state, zip, or plain text."""
    parts = F.array(*[F.trim(F.coalesce(F.get_json_object(c, f"$.{p}"), F.lit(""))) for p in _PARTS])
    joined = F.array_join(F.filter(parts, lambda x: x != ""), ", ")
    return F.when(F.trim(c).startswith("{"), joined).otherwise(F.trim(F.coalesce(c, F.lit(""))))


def people(c: Column) -> Column:
    """Array of struct(name, title) from a JSON list of objects, a JSON list of names, one object, or text split at ; and |."""
    kind = "array<struct<name:string,title:string>>"
    text = F.trim(F.coalesce(c, F.lit("")))
    objects = F.from_json(text, kind)
    one = F.array(F.from_json(text, "struct<name:string,title:string>"))
    plain = lambda names: F.transform(names, lambda n: F.struct(F.trim(n).alias("name"), F.lit(None).cast("string").alias("title")))
    names = plain(F.from_json(text, "array<string>"))
    found = F.when(text.startswith("[{"), objects).when(text.startswith("["), names).when(text.startswith("{"), one).otherwise(plain(F.split(text, "[;|]")))
    return F.filter(F.coalesce(found, F.array().cast(kind)), lambda p: F.coalesce(p["name"], F.lit("")) != "")


def address_record(c: Column, mailing: Column | None = None) -> Column:
    """struct(text, building, unit, zip, box, completeness, scope) of an address text; a mailing address is no more exact than that."""
    a, line = address_key(c), address_line(c)
    box = line.contains("PO BOX") | line.contains("P O BOX")
    hidden = reduce(lambda x, y: x | y, [line.contains(w) for w in ("GENERAL DELIVERY", "UNKNOWN", "REDACTED", "PRIVATE")])
    whole = a["house_number"].isNotNull() & (a["building"] != "")
    exact = F.when(a["unit"].isNotNull(), "EXACT_UNIT").otherwise("EXACT_BUILDING")
    exact = exact if mailing is None else F.when(mailing, "MAILING_ONLY").otherwise(exact)
    scope = F.when(box, "PO_BOX").when(hidden, "GENERALIZED").when(~whole, "INCOMPLETE").otherwise(exact)
    completeness = F.when(box | hidden, "limited").when(~whole, "incomplete").otherwise("complete")
    return F.struct(line.alias("text"), a["building"].alias("building"), a["unit"].alias("unit"), a["zip"].alias("zip"), box.alias("box"), completeness.alias("completeness"), scope.alias("scope"))


_OFFICER = "struct<name:string,title:string,officer_type:string,position:string,address:string>"
FILING = f"corporation_number string, corporation_name string, status string, file_date string, principal_address string, mailing_address string, registered_agent struct<name:string,address:string>, officers array<{_OFFICER}>"


def filings(rows: DataFrame) -> DataFrame:
    """Flat rows of filings (``FILING``): what is missing in each is named, and the first of each corporation number counts.

    A filing without a number is a row of its own. Addresses may be objects or text.
    """
    line = lambda c: address_line(address_text(F.col(c)))
    said = lambda c: F.trim(F.coalesce(c, F.lit("")))
    officers_of = F.filter(F.coalesce("officers", F.array().cast(f"array<{_OFFICER}>")), lambda p: said(p["name"]) != "")
    flat = rows.select(
        said(F.col("corporation_number")).alias("corporation_number"), said(F.col("corporation_name")).alias("corporation_name"), "status", "file_date", line("principal_address").alias("principal_address"), line("mailing_address").alias("mailing_address"),
        said(F.col("registered_agent.name")).alias("agent"), line("registered_agent.address").alias("agent_address"), officers_of.alias("officers"),
    )
    missing = F.array_compact(F.array(*[F.when(F.col(c) == "", F.lit(c)) for c in ("corporation_number", "corporation_name", "principal_address")]))
    flat = flat.withColumn("missing", F.array_join(missing, "|")).withColumn("incomplete", F.size(missing) > 0)
    rest = [c for c in flat.columns if c != "corporation_number"]
    order = F.struct(F.coalesce("file_date", F.lit("")), "corporation_name", "principal_address", "agent")
    numbered = flat.where("corporation_number <> ''").groupBy("corporation_number").agg(F.min_by(F.struct(*rest), order).alias("r")).select("corporation_number", "r.*")
    return numbered.unionByName(flat.where("corporation_number = ''"))


def officers(flat: DataFrame) -> DataFrame:
    """(corporation_number, officer_id, name, title, address, nth) of filings with a number.

    An officer's id goes by all that is said of them, not by their place in the filing; those that are alike in all of it
    are numbered.
    """
    said = lambda c: F.trim(F.coalesce(F.col(f"o.{c}"), F.lit("")))
    one = flat.where("corporation_number <> ''").select("corporation_number", F.explode("officers").alias("o"))
    one = one.select("corporation_number", said("name").alias("name"), said("title").alias("title"), said("officer_type").alias("officer_type"), said("position").alias("position"), address_line(address_text(F.col("o.address"))).alias("address"))
    known = F.concat_ws("|", F.coalesce(person_name(F.col("name"))["full"], F.lit("")), "title", "officer_type", "position", "address", "name")
    one = one.withColumn("fingerprint", F.substring(F.sha2(known.cast("binary"), 256), 1, 16))
    nth = F.row_number().over(W.partitionBy("corporation_number", "fingerprint").orderBy("name")).cast("long")
    return one.withColumn("nth", nth).select("corporation_number", F.concat_ws(":", F.lit("person:sunbiz_daily"), "corporation_number", F.lit("officer"), "fingerprint", F.col("nth").cast("string")).alias("officer_id"), "name", "title", "address", "nth")


def filing_entities(flat: DataFrame) -> DataFrame:
    """(entity_id, entity_type, display_name, source_record_id) of filings with a number: the first record of each entity."""
    own = flat.where("corporation_number <> ''")
    number = F.col("corporation_number")
    one = lambda entity_id, kind, name, record: F.struct(entity_id.alias("entity_id"), F.lit(kind).alias("entity_type"), name.alias("display_name"), record.alias("source_record_id"))
    place = lambda c, role: F.when(F.col(c) != "", one(F.concat(F.lit("address:"), F.col(c)), "address", F.col(c), F.concat_ws(":", number, F.lit(role))))
    made = F.array_compact(F.array(
        one(F.concat(F.lit("business:sunbiz_daily:"), number), "business", F.col("corporation_name"), number), place("principal_address", "principal"), place("mailing_address", "mailing"), place("agent_address", "registered_agent"),
        F.when(F.col("agent") != "", one(F.concat(F.lit("registered_agent:sunbiz_daily:"), number), "registered_agent", F.col("agent"), F.concat_ws(":", number, F.lit("registered_agent")))),
    ))
    rows = own.select(F.explode(made).alias("e")).select("e.*")
    people = officers(own)
    rows = rows.unionByName(people.select(F.col("officer_id").alias("entity_id"), F.lit("officer").alias("entity_type"), F.col("name").alias("display_name"), F.regexp_replace("officer_id", "^person:sunbiz_daily:", "").alias("source_record_id")))
    rows = rows.unionByName(people.where("address <> ''").select(F.concat(F.lit("address:"), "address").alias("entity_id"), F.lit("address").alias("entity_type"), F.col("address").alias("display_name"), F.concat_ws(":", number, F.lit("officer")).alias("source_record_id")))
    first = F.min_by(F.struct("entity_type", "display_name", "source_record_id"), F.struct("source_record_id", "display_name"))
    return rows.groupBy("entity_id").agg(first.alias("r")).select("entity_id", "r.*")


def filing_edges(flat: DataFrame) -> DataFrame:
    """(src, dst, kind) between what ``filing_entities`` gives, each once."""
    own = flat.where("corporation_number <> ''")
    firm, agent = (F.concat(F.lit(p), F.col("corporation_number")) for p in ("business:sunbiz_daily:", "registered_agent:sunbiz_daily:"))
    at = lambda c: F.concat(F.lit("address:"), F.col(c))
    edge = lambda when, src, dst, kind: F.when(when, F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind")))
    has = lambda *columns: reduce(lambda x, y: x & y, [F.col(c) != "" for c in columns])
    made = F.array(
        edge(has("principal_address"), firm, at("principal_address"), "BUSINESS_PRINCIPAL_ADDRESS"), edge(has("principal_address"), firm, at("principal_address"), "BUSINESS_LOCATED_AT"), edge(has("mailing_address"), firm, at("mailing_address"), "BUSINESS_MAILING_ADDRESS"),
        edge(has("agent"), agent, firm, "REGISTERED_AGENT_FOR"), edge(has("agent", "agent_address"), agent, at("agent_address"), "REGISTERED_AGENT_ASSOCIATED_WITH_ADDRESS"), edge(has("agent", "agent_address"), agent, at("agent_address"), "REGISTERED_AGENT_AT_ADDRESS"),
    )
    rows = own.select(F.explode(F.array_compact(made)).alias("e")).select("e.*")
    person = F.col("officer_id")
    theirs = F.array(edge(F.lit(True), person, firm, "OFFICER_OF"), edge(has("address"), person, at("address"), "OFFICER_ASSOCIATED_WITH_ADDRESS"), edge(has("address"), person, at("address"), "OFFICER_AT_ADDRESS"))
    return rows.unionByName(officers(own).select(F.explode(F.array_compact(theirs)).alias("e")).select("e.*")).distinct()

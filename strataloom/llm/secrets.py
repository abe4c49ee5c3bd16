"""Secret scans with multipart credential linking. SQL functions only.

Strong spans stand for themselves: assignments, access identifiers, long hex strings. Weak candidates are what a secret or
an endpoint looks like in any text: a run of exactly 40 base64 characters with both letters and digits, or a URL. They
are reported only where a complementary part is near: for a weak secret an access identifier or an endpoint, for an
endpoint an access identifier, an assignment or a weak secret. Near means in the same document with at most `scope` code
points between the spans. The interval join meets on (document, block of `scope` code points), so even a document full of
candidates is many small groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: In the order in which equal starts stand.
KINDS = ("assign", "access", "hex", "secret", "endpoint")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that reaches the least length is found as a whole, one that doesn't is dropped, as if found and then measured.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: An '=' before it is an assignment's sign, one after it is padding of a longer run.
SECRET = r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])(?=[0-9+/]*[A-Za-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"""https?://[^\x00-\x20"'<>]+"""
ASSIGN_LEAST = 6
SCOPE = 400
SPAN = "struct<start: bigint, stop: bigint>"


#: Matches, or code points, that are folded one after the other; longer arrays and texts are folded in parts of so many.
PART = 128
PIECE = 4096


def _let(value: Column, body) -> Column:
    """body(value) with value computed once for a row."""
    return F.transform(F.array(value), body)[0]


def _spans(text: Column, pattern: str, group_least: int = 0) -> Column:
    """Code-point spans of the pattern's leftmost non-overlapping matches; with group_least, group 1 has so many characters.

    The gaps between matches and the matches alternate, so running sums of their lengths are the bounds. A fold copies its
    array at each step, so parts of PART matches are folded by themselves, each from the sum of the parts before it.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x).cast("long"))
    sized = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.length(x)) if group_least else found
    zero, none = F.lit(0).cast("long"), F.array().cast(f"array<{SPAN}>")

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + x["gap"]
        end = begin + F.coalesce(x["found"], F.lit(0))
        fits = x["found"].isNotNull() & (x["inner"] >= group_least)
        span = F.array(F.struct(begin.alias("start"), end.alias("stop")))
        return F.struct(end.alias("at"), F.when(fits, F.concat(a["out"], span)).otherwise(a["out"]).alias("out"))

    def bounds(every: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / PART).cast("int")), lambda k: F.slice(every, k * PART + 1, F.lit(PART)))

        def of_parts(parts: Column) -> Column:
            length = lambda part: F.aggregate(part, zero, lambda a, x: a + x["gap"] + F.coalesce(x["found"], zero))
            starts = F.aggregate(parts, F.array(zero), lambda a, part: F.concat(a, F.array(F.element_at(a, -1) + length(part))))
            fold = lambda part, at: F.aggregate(part, F.struct(at.alias("at"), none.alias("out")), step, lambda a: a["out"])
            return _let(starts, lambda s: F.flatten(F.transform(parts, lambda part, k: fold(part, s[k]))))

        return _let(cut, of_parts)

    parts = F.arrays_zip(gaps.alias("gap"), found.alias("found"), sized.alias("inner"))
    return F.when(text.rlike(pattern), _let(parts, bounds)).otherwise(none)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, place, assign, access, hex, secret, endpoint) with an array of spans for each kind; no text.

    place is the text's SHA-256: rows of equal id and text share it, and so all their links.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    t = F.col("text")
    return rows.select(
        "doc_id", F.unhex(F.sha2("text", 256)).alias("place"),
        _spans(t, ASSIGN, ASSIGN_LEAST).alias("assign"), _spans(t, ACCESS).alias("access"), _spans(t, HEX).alias("hex"),
        _spans(t, SECRET).alias("secret"), _spans(t, ENDPOINT).alias("endpoint"),
    )


def _tagged(kind: str) -> Column:
    """A kind's spans as (start, kind, stop), which sort by start, then kind."""
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["stop"].alias("stop")))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, place, weak) with the weak spans (start, kind, stop) that have a complementary part in scope."""
    parts = lambda kinds: F.concat(*map(_tagged, kinds))
    busy = found.where((F.size("secret") > 0) | (F.size("endpoint") > 0))
    block = lambda at: F.expr(f"{at} div {scope}")
    weak = busy.select("doc_id", "place", F.explode(parts(("secret", "endpoint"))).alias("w")).select("doc_id", "place", "w.*").distinct()
    weak = weak.withColumn("block", F.explode(F.sequence(block("start") - 1, block("stop") + 1)))
    anchor = busy.select("doc_id", "place", F.explode(parts(("assign", "access", "secret", "endpoint"))).alias("p")).select("doc_id", "place", "p.*").distinct()
    anchor = anchor.withColumn("block", F.explode(F.sequence(block("start"), block("stop"))))
    anchor = anchor.withColumnsRenamed({"kind": "by", "start": "by_start", "stop": "by_stop", "doc_id": "by_doc", "place": "by_place"})
    k, by = F.col("kind"), F.col("by")
    access, assign, secret, endpoint = (KINDS.index(x) for x in ("access", "assign", "secret", "endpoint"))
    fits = ((k == secret) & by.isin(access, endpoint)) | ((k == endpoint) & by.isin(access, assign, secret))
    near = (F.col("by_start") - F.col("stop") <= scope) & (F.col("start") - F.col("by_stop") <= scope)
    same = F.col("doc_id").eqNullSafe(F.col("by_doc")) & (F.col("place") == F.col("by_place")) & (weak.block == anchor.block)
    kept = weak.join(anchor, same & near & fits, "left_semi").select("doc_id", "place", "start", "kind", "stop").distinct()
    return kept.groupBy("doc_id", "place").agg(F.collect_list(F.struct("start", "kind", "stop")).alias("weak"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(doc_id, found) for each row of docs; found is the sorted array of (start, kind, stop) of all spans.

    Null texts are empty. Repeated rows give repeated results, a null id is a document of its own, an empty table gives an
    empty result, and other columns are ignored.
    """
    return _scanned(docs, id_col, text_col, scope).select("doc_id", "found")


def _scanned(docs: DataFrame, id_col: str, text_col: str, scope: int) -> DataFrame:
    found = materialize(spans(docs, id_col, text_col), "spans")
    links = linked(found, scope).withColumnsRenamed({"doc_id": "link_doc", "place": "link_place"})
    out = found.join(links, F.col("doc_id").eqNullSafe(F.col("link_doc")) & (F.col("place") == F.col("link_place")), "left")
    each = [_tagged(k) for k in KINDS[:3]]
    weak = F.coalesce("weak", F.array().cast("array<struct<start: bigint, kind: int, stop: bigint>>"))
    return out.select("doc_id", F.sort_array(F.concat(*each)).alias("base"), F.sort_array(F.concat(*each, weak)).alias("found"))


def joined(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row of docs."""
    rows = _scanned(docs, id_col, text_col, scope)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *map(count, KINDS[:3]), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", scope: int = SCOPE, mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span of the text replaced by `mark`, overlapping spans by one; all columns and rows stay.

    A null text stays null. The base kinds are cut in place; weak spans are cut where the links say so.
    """
    names = {"place": "_secret_place", "id": "_secret_id", "found": "_secret_found"}
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    here = docs.withColumn(names["id"], F.unhex(F.sha2(text, 256)))
    found = scan(here.select(F.col(names["id"]).alias("doc_id"), F.col(text_col).alias("text")), scope=scope)
    found = found.where(F.size("found") > 0).groupBy("doc_id").agg(F.first("found").alias(names["found"])).withColumnRenamed("doc_id", names["place"])
    found = materialize(found, "found")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def cut(piece: Column, k: Column) -> Column:
        # What the spans leave of the code points from `low`; a mark is put where its span starts.
        low, size = k.cast("long") * PIECE, F.length(piece)
        own = F.filter(names["found"], lambda s: (s["stop"] > low) & (s["start"] < low + size))

        def step(a: Column, s: Column) -> Column:
            begin, end = s["start"] - low, s["stop"] - low
            gap = F.substring(piece, a["at"].cast("int") + 1, F.greatest((begin - a["at"]).cast("int"), F.lit(0)))
            joined = (begin < 0) | ((begin < a["at"]) & (a["at"] > 0))
            return F.struct(F.when(joined, a["out"]).otherwise(F.concat(a["out"], gap, F.lit(mark))).alias("out"), F.greatest(a["at"], end).alias("at"))

        return F.aggregate(own, start, step, lambda a: F.concat(a["out"], F.substring(piece, F.least(a["at"], size).cast("int") + 1, size)))

    # Pieces of a text are cut each by itself, since places in a string are counted from its start.
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    clean = F.array_join(F.transform(pieces, cut), "")
    out = here.join(found, F.col(names["id"]) == F.col(names["place"]), "left").withColumn(text_col, F.when(F.col(names["found"]).isNotNull(), clean).otherwise(F.col(text_col)))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))

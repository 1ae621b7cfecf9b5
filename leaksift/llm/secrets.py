"""Secret scans: base patterns and multipart credential linking.

Base spans are certain by their form. Other parts of a credential are weak
alone: a login, an endpoint, a password under another name or a long mixed
token says little. They are joined by an interval join inside a scope, and a
weak part is reported only where complementary parts lie close together.

Only built-in column functions are used. Positions are code points, found from
the pieces between matches: a match starts after all earlier pieces and matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksift.llm.common import fresh
from leaksift.session import materialise

# The base patterns and their least lengths.
KEYWORD = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = KEYWORD + "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_LEAST = 6
ACCESS = "AKIA[A-Z0-9]{16,}"  # runs of 20 characters and more; a shorter run holds no longer one
HEX = "[0-9a-f]{24,}"

# Parts that count only together. A name may follow an underscore (DB_USER), no letter or digit.
LOGIN = r"(?i)(?<![\p{L}\p{N}])(?:user(?:name|_?id)?|login|account|client_?id|access_?key_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@+-]{3,}"
ENDPOINT = r"(?i)\b(?:(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]{4,}|(?:\d{1,3}\.){3}\d{1,3}(?::\d{2,5})?)"
WEAK = r"(?i)(?<![\p{L}\p{N}])(?:pwd|pass|passphrase|auth|bearer|credential|private_?key|signature)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6,}"
# Each look-ahead ends at the first character of its class, so a token of any length is read a fixed number of times.
MIXED = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[a-z0-9+/_=-]*+[A-Z])(?=[A-Z0-9+/_=-]*+[a-z])[A-Za-z0-9+/_=-]{20,}"

KINDS = ("assign", "access", "hex", "login", "endpoint", "weak", "mixed")
BASE = KINDS[:3]
SCOPE = 200
SPAN = "array<struct<start:int,kind:int,end:int>>"
# The role a kind plays: identifier, secret, endpoint.
ROLE = {"access": "id", "login": "id", "endpoint": "at", "assign": "secret", "hex": "secret", "weak": "secret", "mixed": "secret"}


def spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans of all leftmost non-overlapping matches, in order; ``keep(matches, i)`` drops some."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, match: Column) -> Column:
        begin = acc["at"] + F.length(F.get(gaps, acc["i"]))
        end = begin + F.length(match)
        one = F.struct(begin.cast("int").alias("start"), F.lit(kind).alias("kind"), end.cast("int").alias("end"))
        return F.struct(end.alias("at"), (acc["i"] + 1).alias("i"), F.concat(acc["out"], F.array(one)).alias("out"))

    every = F.aggregate(found, start, step)["out"]
    if keep is not None:
        every = F.filter(every, keep)
    # Most texts hold no match: one search decides before pieces are cut.
    return F.when(F.regexp_like(text, F.lit(pattern)), every).otherwise(F.array().cast(SPAN))


def part_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, a digest of the text, base spans and weak parts; the text goes no further."""
    body = F.coalesce(F.col(text), F.lit(""))
    values = F.regexp_extract_all(body, F.lit(ASSIGN), F.lit(2))
    assign = spans(body, ASSIGN, 0, lambda s, i: F.length(F.get(values, i)) >= ASSIGN_LEAST)
    base = F.concat(assign, spans(body, ACCESS, 1), spans(body, HEX, 2))
    parts = F.concat(*[spans(body, p, 3 + i) for i, p in enumerate((LOGIN, ENDPOINT, WEAK, MIXED))])
    return docs.select(F.col(key).alias("_key"), F.xxhash64(body).alias("_text"), base.alias("base"), parts.alias("parts"))


def linked_parts(table: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts with a complementary part within ``scope`` code points: ``_key``, ``_text``, ``linked``.

    Parts are dealt by (row, scope-sized slice of the text). The gap is measured
    from the nearer ends, so a part goes to the slices of its first and last
    code point and the ones beside them and meets all that begin or end there:
    no text, however long, is compared with itself as a whole. Two parts
    complement each other when their roles differ and at least one is a secret.
    """
    roles = F.create_map(*[v for i, k in enumerate(KINDS) for v in (F.lit(i), F.lit(ROLE[k]))])
    rows = (table.where(F.size("parts") > 0).select("_key", "_text", F.concat("base", "parts").alias("_all")).dropDuplicates(["_key", "_text"])
            .select("_key", "_text", F.inline("_all")).withColumn("role", roles[F.col("kind")]))
    first, last = F.floor(F.col("start") / scope), F.floor(F.col("end") / scope)
    weak = rows.where(F.col("kind") >= len(BASE)).withColumn("slice", F.explode(F.array_distinct(F.array(first - 1, first, last, last + 1))))
    # What ends before a part is met by its end, what follows it by its start.
    near = rows.select("_key", "_text", F.col("role").alias("role2"), F.col("start").alias("start2"), F.col("end").alias("end2"),
                       F.explode(F.array_distinct(F.array(first, last))).alias("slice"))
    meet = weak.join(near, [weak["_key"].eqNullSafe(near["_key"]), weak["_text"] == near["_text"], weak["slice"] == near["slice"]])
    gap = F.greatest(F.col("start2") - F.col("end"), F.col("start") - F.col("end2"))
    kept = meet.where((gap >= 0) & (gap <= scope) & (F.col("role") != F.col("role2"))
                      & ((F.col("role") == "secret") | (F.col("role2") == "secret")))
    return (kept.groupBy(weak["_key"], weak["_text"])
            .agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("linked")))


def named(spans_column: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.array_sort(spans_column), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE,
                 digest: str | None = None) -> DataFrame:
    """One row per document: ``key``, ``base`` and ``linked`` spans (start, kind number, end).

    A null text is an empty one and has no spans; a null key is a key; equal
    rows get equal spans; an empty table gives an empty one; other columns are
    ignored. ``digest`` names a column for the text's digest, if it is wanted.
    """
    table = materialise(part_table(docs, key, text))
    found = linked_parts(table, scope).withColumnsRenamed({"_key": "_k", "_text": "_t"})
    joined = table.join(found, table["_key"].eqNullSafe(found["_k"]) & (table["_text"] == found["_t"]), "left")
    return joined.select(F.col("_key").alias(key), *([F.col("_text").alias(digest)] if digest else []), "base",
                         F.coalesce("linked", F.array().cast(SPAN)).alias("linked"))


def secret_digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts per base kind, a digest of the base spans and all spans as text."""
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        key, *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(named(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        named(F.concat("base", "linked")).alias("spans"))


def masked(text: Column, found: Column, mark: str) -> Column:
    """``text`` with the code points of all spans replaced, overlapping spans by one ``mark``."""
    body = F.coalesce(text, F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        cut = F.concat(F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(fresh, F.concat(acc["out"], F.array(cut))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(F.array_sort(found), start, step)
    return F.concat(F.concat_ws("", done["out"]), F.substring(body, done["at"] + 1, F.length(body)))


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """``docs`` with all base and linked spans of ``text`` replaced by ``mark``; every row and column kept.

    A text without a span stays as it is, null included. Rows are matched to
    their spans by key and text digest.
    """
    k, t, f = (fresh(docs, c) for c in ("_found_key", "_found_text", "_found"))
    found = (secret_spans(docs, key, text, scope, digest=t)
             .select(F.col(key).alias(k), t, F.concat("base", "linked").alias(f))
             .where(F.size(f) > 0).dropDuplicates([k, t]))
    joined = docs.join(found, docs[key].eqNullSafe(found[k])
                       & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == found[t]), "left")
    changed = F.when(F.col(f).isNull(), F.col(text)).otherwise(masked(F.col(text), F.col(f), mark))
    return joined.withColumn(text, changed).select(*docs.columns)

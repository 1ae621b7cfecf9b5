"""Paths, group keys, labels and names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def slash_path(path: Column) -> Column:
    """Backslashes to slashes."""
    return F.translate(path, "\\", "/")


def basename(path: Column) -> Column:
    return F.substring_index(slash_path(path), "/", -1)


def stem(path: Column) -> Column:
    """Basename without its last extension; a leading dot is kept."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def relative_key(path: Column, markers: Sequence[str] = ("training/", "validation/")) -> Column:
    """The path from the first listed marker it holds, else without leading dots and slashes."""
    clean = slash_path(path)
    found = [
        F.when(F.instr(clean, m) > 0, clean.substr(F.instr(clean, m), F.length(clean)))
        for m in markers
    ]
    return F.coalesce(*found, F.regexp_replace(clean, r"^[./]+", ""))


def expand_root(path: Column, placeholder: str, root: str, doubled: str = "Dataset/") -> Column:
    """A placeholder prefix to a concrete root, one repeated folder removed."""
    rest = F.ltrim(F.substring(path, len(placeholder) + 1, 1 << 30), F.lit("/"))
    once = F.when(F.lit(root.rstrip("/") + "/").endswith("/" + doubled) & rest.startswith(doubled),
                  F.substring(rest, len(doubled) + 1, 1 << 30)).otherwise(rest)
    return F.when(path.startswith(placeholder), F.concat(F.lit(root.rstrip("/") + "/"), once)).otherwise(path)


def resolve_path(path: Column, default_root: str, reference_root: str,
                 split_prefix: str, labelled_prefixes: Sequence[str]) -> Column:
    """Concrete path for the prefixes a corpus has used over time.

    Absolute paths pass; ``split_prefix`` keeps class folder and file name under
    the reference root (a bare prefix is an error); ``labelled_prefixes`` are cut
    and the rest put under the reference root; everything else belongs to the
    default root.
    """
    clean = slash_path(path)
    parts = F.filter(F.split(clean, "/"), lambda p: p != "")
    chain = F.when(clean.startswith("/"), clean)
    chain = chain.when(
        clean.startswith(split_prefix),
        F.when(F.size(parts) < 2, F.raise_error(F.concat(F.lit("malformed path: "), path)).cast("string"))
        .otherwise(F.concat_ws("/", F.lit(reference_root), F.element_at(parts, -2), F.element_at(parts, -1))),
    )
    for prefix in labelled_prefixes:
        chain = chain.when(
            clean.startswith(prefix),
            F.concat(F.lit(reference_root + "/"), F.substring(clean, len(prefix) + 1, 1 << 30)),
        )
    return chain.otherwise(F.concat(F.lit(default_root + "/"), clean))


def source_from_path(path: Column, aliases: Mapping[str, str], unknown: str = "UNK") -> Column:
    """Source whose folder name occurs in the path (``aliases``: folder → source)."""
    text = F.lower(F.concat(F.lit("/"), slash_path(path)))
    chain = F.lit(unknown)
    for folder, source in reversed(list(aliases.items())):
        chain = F.when(text.contains(f"/{folder.lower()}/"), source).otherwise(chain)
    return chain


def source_from_id(item: Column, default: str, other: str = "OTHER") -> Column:
    """Capitals before optional digits and ``_``; empty id gives the default."""
    prefix = F.regexp_extract(item, r"^([A-Z]+)\d*_", 1)
    return (F.when(item.isNull() | (item == ""), default)
            .when(prefix != "", prefix).otherwise(other))


def group_key(name: Column) -> Column:
    """Text before the first underscore (the whole name without one)."""
    return F.substring_index(name, "_", 1)


def hex_group_key(name: Column) -> Column:
    """Leading lower-case hex digits before an underscore, or empty."""
    return F.regexp_extract(name, r"^([0-9a-f]+)_", 1)


def verified_group_key(name: Column, source: Column, trusted_source: str,
                       class_names: Sequence[str]) -> Column:
    """A 16-hex-digit prefix of the trusted source; class names and others give empty."""
    base = stem(name)
    prefix = (F.when(base.contains("_"), F.substring_index(base, "_", 1))
              .otherwise(F.substring_index(base, "-", 1)))
    denied = [squash_name(F.lit(c)) for c in class_names]
    ok = ((source == trusted_source) & prefix.rlike("^[0-9a-fA-F]{16}$"))
    if denied:
        ok = ok & ~squash_name(prefix).isin(*denied)
    return F.when(ok, F.lower(prefix)).otherwise("")


def label_first(flags: Mapping[str, Column]) -> Column:
    """Name of the first flag equal to 1, else null."""
    return F.coalesce(*[F.when(flag == 1, name) for name, flag in flags.items()])


def label_argmax(flags: Mapping[str, Column], empty: str | None = None) -> Column:
    """Name of the largest flag, first on ties; all zero gives ``empty``."""
    names = F.array(*[F.lit(n) for n in flags])
    values = F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in flags.values()])
    at = F.array_position(values, F.array_max(values)).cast("int")
    return F.when(F.array_max(values) > 0, F.element_at(names, at)).otherwise(F.lit(empty))


def argmax_index(scores: Column) -> Column:
    """Zero-based position of the largest score, first on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def one_hot(label: Column, classes: Sequence[str]) -> list[Column]:
    """One 0/1 double column per class."""
    return [F.when(label == c, 1.0).otherwise(0.0).alias(c) for c in classes]


def map_label(label: Column, table: Mapping[str, str | None], unknown: str | None = None) -> Column:
    """Lookup in a fixed small class map; absent keys give ``unknown``."""
    chain = F.lit(unknown).cast("string")
    for key, value in table.items():
        chain = F.when(label == key, F.lit(value)).otherwise(chain)
    return chain


def squash_name(name: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "")


def strip_suffixes(name: Column, suffixes: Sequence[str], aliases: Mapping[str, str] | None = None) -> Column:
    """Cut the listed endings in order, then apply exact aliases."""
    for suffix in suffixes:
        name = F.when(name.endswith(suffix), name.substr(F.lit(1), F.length(name) - len(suffix))).otherwise(name)
    for old, new in (aliases or {}).items():
        name = F.when(name == old, new).otherwise(name)
    return name


def partition_label(split: Column, source: Column) -> Column:
    return F.concat_ws("_", split, source)


def band_label(value: Column, bands: Sequence[tuple[int, int]], leftover: str = "other") -> Column:
    """``lo-hi`` of the closed range holding the value; values outside are named, not lost."""
    chain = F.lit(leftover)
    for lo, hi in reversed(list(bands)):
        chain = F.when(value.between(lo, hi), f"{lo}-{hi}").otherwise(chain)
    return F.when(value.isNull(), F.lit(None)).otherwise(chain)


def bin_label(value: Column, edges: Sequence[float]) -> Column:
    """Half-open bins ``[lo,hi)`` named by both edges; the last one is closed."""
    chain = F.lit(None).cast("string")
    last = len(edges) - 2
    for i in range(last, -1, -1):
        lo, hi = edges[i], edges[i + 1]
        inside = (value >= lo) & ((value <= hi) if i == last else (value < hi))
        chain = F.when(inside, f"{lo},{hi}").otherwise(chain)
    return chain


def scrub(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Ordered regular-expression replacements."""
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def scrub_all(value: Column, rules: Sequence[tuple[str, str]], schema: T.DataType | str) -> Column:
    """:func:`scrub` over every string of a nested value of the given type.

    Only string values change: field names, map keys, numbers, escapes and
    nulls stay as they are.
    """
    kind = T.DataType.fromDDL(schema) if isinstance(schema, str) else schema
    if isinstance(kind, T.StringType):
        return scrub(value, rules)
    if isinstance(kind, T.StructType):
        fields = [scrub_all(value.getField(f.name), rules, f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: scrub_all(x, rules, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: scrub_all(x, rules, kind.valueType))
    return value


def entropy(probs: Column, floor: float = 1e-8) -> Column:
    """Shannon entropy (nats) with probabilities clamped from below."""
    terms = F.transform(probs, lambda p: F.greatest(p, F.lit(floor)))
    return -F.aggregate(terms, F.lit(0.0), lambda acc, p: acc + p * F.ln(p))


def joint_max_distance(first: Column, second: Column) -> Column:
    """Larger of two distances, null when either is missing."""
    return F.when(first.isNotNull() & second.isNotNull(), F.greatest(first, second))

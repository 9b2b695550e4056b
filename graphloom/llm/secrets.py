"""Secret scans with multipart credential linking (operator 9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import stash
from .common import row_key

#: Patterns of the base kinds, in the order in which kinds that start together are listed, and the
#: least length of the group that counts (group 0 is the whole match).
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    # Runs of one class only: a run that is long enough is the same match under + and under a least count, and short ones needn't be listed.
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
#: What stands before a name: nothing that belongs to a word of letters and digits. Prefixes that end in '_' may (``aws_secret_access_key``, ``DB_USER``).
LEAD = "(?<![A-Za-z0-9])"
#: Weak parts of a credential: none of them is worth a report alone.
WEAK = [
    ("ident", rf"""(?i){LEAD}(access_?key_?id|client_?id|account_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+_.-]+)""", 2, 3),
    ("phrase", rf"""(?i){LEAD}(secret_?access_?key|client_?secret|private_?key|passphrase|pass|pwd|pin)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=!@#$%^&*-]+)""", 2, 4),
    ("endpoint", r"""(?i)\b(?:https?|ftps?|ssh|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\x20\x09-\x0D"'<>]+""", 0, 8),
]
#: Matches are added up in runs of so many, and then run by run, so that no list that grows with the text is copied for every match.
RUN = 256
#: Parts of kinds that stand in different roles complete each other. Base kinds have roles, too: an assigned value or a long hex
#: string is a secret, an access identifier names its owner.
ROLE = {"assign": "secret", "hex": "secret", "phrase": "secret", "access": "owner", "ident": "owner", "endpoint": "place"}


def spans(text: Column, pattern: str, group: int, least: int) -> Column:
    """``array<struct<start, end>>`` of the matches, in code points, whose group has ``least`` characters.

    Matches and the texts between them, in turn, make up the whole text, so running lengths give the places.
    """
    quoted = F.lit(pattern)
    hits = F.regexp_extract_all(text, quoted, 0)
    gaps = F.split(text, pattern, -1)
    held = F.regexp_extract_all(text, quoted, group) if group else hits
    empty = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(state: Column, part: Column) -> Column:
        begin = state["at"] + part["gap"]
        found = F.struct(begin.alias("start"), (begin + part["hit"]).alias("end"))
        return F.struct((begin + part["hit"]).alias("at"), F.when(part["held"] >= least, F.concat(state["out"], F.array(found))).otherwise(state["out"]).alias("out"))

    def joined(state: Column, run: Column) -> Column:
        moved = F.transform(run["out"], lambda x: F.struct((x["start"] + state["at"]).alias("start"), (x["end"] + state["at"]).alias("end")))
        return F.struct((state["at"] + run["at"]).alias("at"), F.concat(state["out"], F.array(moved)).alias("out"))

    def added(parts: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1)), F.lit(RUN))
        runs = F.transform(firsts, lambda i: F.aggregate(F.slice(parts, i, RUN), start, step))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int>>>").alias("out"))
        return F.aggregate(runs, none, joined, lambda state: F.flatten(state["out"]))

    size = lambda name: lambda x: F.char_length(x).alias(name)
    parts = F.arrays_zip(F.transform(hits, size("hit")).alias("hit"), F.transform(F.slice(gaps, F.lit(1), F.size(hits)), size("gap")).alias("gap"), F.transform(held, size("held")).alias("held"))
    # The lengths are bound to a name, else every run would search the text again.
    return F.when(text.rlike(pattern), F.element_at(F.transform(F.array(parts), added), 1)).otherwise(empty)


def listed(parts: Column) -> Column:
    """``kind:start:end`` by start and then kind as listed, comma-joined; ``parts`` hold ``start, kind, end``."""
    name = F.array(*[F.lit(k) for k, *_ in [*BASE, *WEAK]])
    return F.array_join(F.transform(F.array_sort(parts), lambda p: F.concat_ws(":", F.element_at(name, p["kind"] + 1), p["start"].cast("string"), p["end"].cast("string"))), ",")


def find_secrets(documents: DataFrame, reach: int = 200) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every row of ``documents``.

    Base spans always stay. A weak part is added if a part of another role (secret, owner or
    place), weak or base, begins or ends within ``reach`` code points of it: an interval join of the scopes around the parts. Parts
    are joined by document and cell of ``reach`` positions, so a document full of parts is no single task's load.

    A null text counts as empty and has no spans; rows with a null doc_id keep it; repeated rows have equal
    results. An empty table gives an empty result. Columns other than ``doc_id`` and ``text`` are not read.
    """
    kinds = [*BASE, *WEAK]
    text = F.coalesce(F.col("text"), F.lit(""))
    tag = lambda i: lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"))
    tagged = [F.transform(spans(F.col("text"), p, g, n), tag(i)) for i, (_, p, g, n) in enumerate(kinds)]
    scanned = stash(
        documents.select("doc_id", text.alias("text")).select("doc_id", *row_key("doc_id", "text"), *[c.alias(f"_{i}") for i, c in enumerate(tagged)])
    )
    base, weak = [f"_{i}" for i in range(len(BASE))], [f"_{i}" for i in range(len(BASE), len(kinds))]
    some = scanned.where(" or ".join(f"size({c}) > 0" for c in weak))
    parts = some.select("_k1", "_k2", F.explode(F.concat(*base, *weak)).alias("p")).distinct()
    role = F.array(*[F.lit(ROLE[k]) for k, *_ in kinds])
    parts = parts.select("_k1", "_k2", "p.*", F.element_at(role, F.col("p.kind") + 1).alias("role"))
    # The scope of a weak part covers one or more cells, each base or weak part stands in the cells it touches; an end
    # that lies within the scope lies in a cell of the scope.
    cell = lambda c: F.expr(f"({c}) div {reach}")
    scopes = parts.where(F.col("kind") >= len(BASE)).withColumn("_cell", F.explode(F.sequence(cell(f"greatest(start - {reach}, 0)"), cell(f"end + {reach}"))))
    ends = parts.select("_k1", "_k2", F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("role").alias("r2"), F.explode(F.array_distinct(F.array(cell("start"), cell("end")))).alias("_cell"))
    # One row for each cell and role is enough to tell whether such a part begins or ends near: the least and the greatest place.
    near = ends.groupBy("_k1", "_k2", "_cell", "r2").agg(
        F.collect_set(F.when(F.expr(f"s2 div {reach}") == F.col("_cell"), F.col("s2"))).alias("_s"), F.collect_set(F.when(F.expr(f"e2 div {reach}") == F.col("_cell"), F.col("e2"))).alias("_e")
    )
    within = F.exists(F.concat("_s", "_e"), lambda x: (x >= F.col("start") - reach) & (x <= F.col("end") + reach))
    linked = scopes.join(near, ["_k1", "_k2", "_cell"]).where((F.col("role") != F.col("r2")) & within)
    added = linked.select("_k1", "_k2", F.struct("start", "kind", "end").alias("p")).distinct().groupBy("_k1", "_k2").agg(F.collect_list("p").alias("_added"))
    added = added.select(F.col("_k1").alias("_a1"), F.col("_k2").alias("_a2"), "_added")
    out = scanned.join(added, (F.col("_k1") == F.col("_a1")) & (F.col("_k2") == F.col("_a2")), "left")
    whole = F.concat(*base)
    return out.select(
        "doc_id",
        *[F.size(c).cast("long").alias(f"n_{kinds[i][0]}") for i, c in enumerate(base)],
        F.sha2(listed(whole), 256).alias("base_sha256"),
        listed(F.when(F.col("_added").isNull(), whole).otherwise(F.concat(whole, "_added"))).alias("spans"),
    )

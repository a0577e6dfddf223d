"""Secret scan with corpus-wide ownership frequency.

Every text is scanned for three base kinds (assignments, access keys, long
hex runs). Each candidate value is hashed, and the corpus is asked how many
distinct repositories and owners hold the hash: a value that many owners hold
is a widely copied example, a value of one or two owners that is no placeholder
as a whole is a live-looking credential. Bare occurrences of a live-looking
assigned value anywhere else, between any characters but those of ``PIECE``, are
added as spans of kind ``reuse``. A value that may be a plain word (not 12 or
more characters with a digit and a letter) is sought only if one or two owners
hold it, bare occurrences counted: the word after "password:" is not masked in
all texts. A value without a character of ``PIECE`` is not sought.

Only DataFrame functions run. A match's position comes from splitting the
text at the pattern: pieces and matches alternate, so positions are running
sums of their lengths, taken by a window over the rows of one text (rows hold
lengths, not texts). Counts are made by two partial aggregations, so a value
in a third of all documents sends one row per map task. Values never leave
the scan: only their hashes are shuffled.

Edge cases: null text is empty; a null owner or repository counts as one
owner; repeated rows (equal id and text) are one document and give one row;
rows of one id with different texts give a row each; null ids are kept; an
empty table gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import NO_ID, back_to_id, doc_key, materialize, only_keys, split_by_keys

# fixed values: the base patterns of the contract (Java and SQL syntax)
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: a value's copies are sought by its first piece: boundaries are all other characters, '=', ':' and '/' too
PIECE = r"[A-Za-z0-9+_.-]+"
KINDS = ["assign", "access", "hex", "reuse"]
MIN_ASSIGNED = 6
#: a value held by at most so many owners is owner-specific
LIVE_OWNERS = 2
#: a value that is a placeholder as a whole: such words and runs only
PLACEHOLDER_VALUE = (r"(?i)^(?:(?:example|sample|dummy|changeme|placeholder|redacted|your|x{4,}+|0{6,}+|1{6,}+|a{6,}+"
                     r"|1234567(?:8(?:90?)?)?|abcdef)[+/_.=-]*+){1,40}+$")


def _pieces(text: Column, pattern: str, group: int) -> Column:
    """(gap, whole, value) of each match: characters since the last match, the match, its group."""
    gaps, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("g"), whole.alias("w"), value.alias("v")),
                       lambda m: F.struct(F.length(m["g"]).alias("gap"), F.length(m["w"]).alias("len"),
                                          F.length(m["v"]).alias("value_len"),
                                          F.sha2(m["v"].cast("binary"), 256).alias("hash"),
                                          F.xxhash64(F.regexp_extract(m["v"], PIECE, 0)).alias("head"),
                                          F.when(m["v"].rlike(PIECE), F.length(F.regexp_extract(m["v"], "^[=/]*", 0))).alias("off"),
                                          m["v"].rlike(PLACEHOLDER_VALUE).alias("placeholder"),
                                          (m["v"].rlike("[0-9]") & m["v"].rlike("[A-Za-z]")
                                           & (F.length(m["v"]) >= F.lit(12))).alias("random")))
    return F.when(text.rlike(pattern), rows)


def candidates(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """_id, _th, _owner, _repo, kind, start, end, hash, ...: every match of the
    base kinds, in code points."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text).alias("_th"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("_owner"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("_repo"),
        F.array(*[F.struct(F.lit(k).alias("kind"), _pieces(text, p, g).alias("m"))
                  for k, p, g in (("assign", ASSIGN, 2), ("access", ACCESS, 0), ("hex", HEX, 0))])
        .alias("found"))
    by_kind = base.select("_id", "_th", "_owner", "_repo", F.explode("found").alias("f"))
    rows = by_kind.select("_id", "_th", "_owner", "_repo", F.col("f.kind").alias("kind"), F.posexplode("f.m").alias("i", "m"))
    # a match may be in several repeated rows of one document: one stays
    rows = rows.dropDuplicates(["_id", "_th", "_owner", "_repo", "kind", "i"])
    run = Window.partitionBy("_id", "_th", "_owner", "_repo", "kind").orderBy("i")
    end = F.sum(F.col("m.gap") + F.col("m.len")).over(run)
    return (rows.select("_id", "_th", "_owner", "_repo", "kind", "m.*", end.cast("long").alias("end"))
            .withColumn("start", F.col("end") - F.col("len"))
            .where((F.col("kind") != "assign") | (F.col("value_len") >= MIN_ASSIGNED)))


def ownership(found: DataFrame) -> DataFrame:
    """Distinct owners and repositories of every value that a base kind found."""
    per_repo = found.groupBy("hash", "_owner", "_repo").agg(
        F.max("placeholder").alias("placeholder"), F.max(F.col("kind") == "assign").alias("assigned"))
    per_owner = per_repo.groupBy("hash", "_owner").agg(
        F.count(F.lit(1)).alias("repos"), F.max("placeholder").alias("placeholder"), F.max("assigned").alias("assigned"))
    return per_owner.groupBy("hash").agg(
        F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"),
        F.max("placeholder").alias("placeholder"), F.max("assigned").alias("assigned")
    ).withColumn("live", (F.col("n_owners") <= LIVE_OWNERS) & ~F.col("placeholder"))


def copies(docs: DataFrame, heads: DataFrame, owner: str) -> DataFrame:
    """_id, _th, start, end, hash: every occurrence of the values ``heads`` (hash,
    head, off, value_len, random). Texts that hold a value's first piece are
    found by a bitmap filter; positions are taken in those only."""
    texts = docs.select(doc_key().alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th"),
                        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("_owner"), F.coalesce("text", F.lit("")).alias("text"))
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(PIECE), F.lit(0)))
    tokens = texts.select("_id", "_th", F.explode(words).alias("w")).select("_id", "_th", F.xxhash64("w").alias("head"))
    on = ["_id", "_th"]
    holding = materialize(only_keys(tokens, heads, ["head"]).join(heads.select("head").distinct(), "head", "left_semi")
                          .select(*on).distinct(), "secret_holders")
    held = materialize(only_keys(texts, holding, on).join(holding, on, "left_semi"), "secret_texts")
    once = held.select(*on, "text").dropDuplicates(on)
    gaps, whole = F.split("text", PIECE, -1), F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))
    pieces = once.select(*on, F.posexplode(F.zip_with(F.slice(gaps, 1, F.size(whole)), whole, lambda g, w: F.struct(
        F.length(g).alias("gap"), F.length(w).alias("len"), F.xxhash64(w).alias("head")))).alias("i", "m"))
    run = Window.partitionBy(*on).orderBy("i")
    placed = pieces.select(*on, "m.head", (F.sum(F.col("m.gap") + F.col("m.len")).over(run) - F.col("m.len")).alias("at"))
    start, end = F.col("at") - F.col("off"), F.col("at") - F.col("off") + F.col("value_len")
    maybe = placed.join(heads, "head").select(*on, "hash", "random", start.alias("start"), end.alias("end")).where("start >= 0")
    same = F.sha2(F.substr("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).cast("binary"), 256)
    # a value that ends in a boundary character needs none behind it
    around = F.substr("text", F.col("end").cast("int"), F.lit(2))
    found = materialize(maybe.join(once, on).where((same == F.col("hash")) & ~around.rlike("^[A-Za-z0-9+_.-]{2}"))
                        .select(*on, "hash", "random", "start", "end").distinct(), "secret_copies")
    owners = (found.where("not random").select(*on, "hash").distinct().join(held.select(*on, "_owner").distinct(), on)
              .select("hash", "_owner").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n")))
    common = owners.where(F.col("n") > LIVE_OWNERS).select("hash")
    return found.join(common, "hash", "left_anti").select(back_to_id("_id").alias("_id"), "_th", "start", "end", "hash")


def find_spans(docs: DataFrame, owner: str = "source", repository: str = "source") -> DataFrame:
    """One row per span: _id, _th, kind, start, end, hash, n_owners, n_repos, live.
    Base spans all stay; ``reuse`` spans are bare copies of live-looking
    assigned values that no base span covers."""
    found = materialize(candidates(docs, owner, repository), "secret_candidates")
    held = materialize(ownership(found), "secret_owners").drop("placeholder")
    heads = materialize(found.where("kind = 'assign' and off is not null").select("hash", "head", "off", "value_len", "random").distinct()
                        .join(held.where("live").select("hash"), "hash"), "secret_heads")
    reused = copies(docs, heads, owner).select("_id", "_th", F.lit("reuse").alias("kind"), "start", "end", "hash")
    spans = (found.select("_id", "_th", "kind", "start", "end", "hash").unionByName(reused)
             .distinct().join(held, "hash", "left"))
    # a bare copy inside a base span of the same text is that span: the running
    # maximum of base ends before it, and the next base start, tell
    before = Window.partitionBy("_id", "_th").orderBy("start", F.col("kind") == "reuse").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("_id", "_th").orderBy(F.col("start").desc(), F.col("kind") == "reuse").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = F.col("kind") != "reuse"
    return (spans.withColumn("_last", F.max(F.when(base, F.col("end"))).over(before))
            .withColumn("_next", F.min(F.when(base, F.col("start"))).over(after))
            .where(base | ((F.coalesce(F.col("_last"), F.lit(0)) <= F.col("start"))
                           & (F.coalesce(F.col("_next"), F.lit(2 ** 62)) >= F.col("end"))))
            .select("_id", "_th", "kind", "start", "end", "hash", "n_owners", "n_repos",
                    F.coalesce("live", F.lit(False)).alias("live")))


def _listed(keep: Column) -> Column:
    order = F.when(F.col("kind") == "assign", 0).when(F.col("kind") == "access", 1).when(F.col("kind") == "hex", 2).otherwise(3)
    item = F.struct(F.col("start").alias("s"), order.alias("k"), F.concat_ws(":", "kind", "start", "end").alias("t"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, item))), lambda x: x["t"]), ",")


def scan(docs: DataFrame, owner: str = "source", repository: str = "source") -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example."""
    spans = find_spans(docs, owner, repository)
    base = F.col("kind") != "reuse"
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    per_doc = spans.groupBy("_id", "_th").agg(
        *[count(F.col("kind") == k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        _listed(base).alias("base"), _listed(F.lit(True)).alias("spans"),
        count(F.col("live")).alias("n_live"), count(base & ~F.col("live")).alias("n_example"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                      F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_th")).distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return (ids.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (ids["_th"] == per_doc["_th"]), "left")
            .select("doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"),
                    F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
                    F.coalesce("spans", F.lit("")).alias("spans"), zero("n_live"), zero("n_example")))


def redact(docs: DataFrame, owner: str = "source", repository: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` (all columns) with each live-looking span replaced by ``mark``.

    Overlapping spans are merged first. The text is rebuilt from the pieces
    between spans; only documents that have live spans change."""
    spans = find_spans(docs, owner, repository).where("live")
    order = Window.partitionBy("_id", "_th").orderBy("start", "end")
    seen = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = spans.withColumn("_new", F.when(seen.isNull() | (F.col("start") > seen), 1).otherwise(0))
    merged = (starts.withColumn("_run", F.sum("_new").over(order))
              .groupBy("_id", "_th", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
              .groupBy("_id", "_th").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_cuts")))
    merged = materialize(merged.select(F.coalesce("_id", F.lit(NO_ID)).alias("_key_id"), F.col("_th").alias("_key_th"), "_cuts"), "secret_cuts")
    keyed = docs.withColumn("_key_id", doc_key()).withColumn("_key_th", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    maybe, clean = split_by_keys(keyed, merged, ["_key_id", "_key_th"])
    joined = maybe.join(merged, ["_key_id", "_key_th"], "left")
    keep_from = F.concat(F.array(F.lit(0).cast("long")), F.transform("_cuts", lambda c: c["end"]))
    keep_to = F.concat(F.transform("_cuts", lambda c: c["start"]), F.array(F.length("text").cast("long")))
    kept = F.zip_with(keep_from, keep_to, lambda a, b: F.substr(F.col("text"), (a + 1).cast("int"), (b - a).cast("int")))
    cleaned = joined.withColumn("text", F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(F.array_join(kept, mark)))
    return clean.select(*docs.columns).unionByName(cleaned.select(*docs.columns))

"""Document fingerprints from closed syncmers of tokens.  DataFrame functions only.

A text is cut into tokens (below), which have hashes; a k-mer is ``K`` neighbouring tokens.  A k-mer
is an anchor if the least of its inner tokens' hashes (its s-mers, s = 1) stands first or last in it,
which depends on the k-mer alone.  So a passage keeps its anchors wherever it stands, and at least
one of any two neighbouring k-mers is an anchor.  A fingerprint holds all anchors with their places;
likeness is how much of two texts the anchors that both have cover.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, literal_longs, token_hash

K = 3
#: Letters of scripts written without spaces stand alone; other words are cut every 16 characters.
TOKEN = "[\\x{0E00}-\\x{0EFF}\\x{1000}-\\x{109F}\\x{1780}-\\x{17FF}\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}\\x{AC00}-\\x{D7AF}]|[^\\x20\\x09-\\x0D]{1,16}"
#: Bits by which the hashes of an anchor's tokens (32 bits each) are set off in its hash of 64 bits.
SHIFT = 16
#: Hexadecimal digits of an anchor in a fingerprint: its distance from the one before, and its hash.
ENTRY = 17
#: Characters that one bucket of neighbouring documents holds, if so many buckets are allowed.
BUCKET_CHARS = 2_000_000


def token_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), token_hash)


def _joined(tokens: list[Column]) -> Column:
    """Order-keeping hash of up to K token hashes: each is shifted further, and all are added without carry."""
    out = tokens[0]
    for j, t in enumerate(tokens[1:], 1):
        out = out.bitwiseXOR(F.shiftleft(t, SHIFT * j))
    return out


def anchors(text: Column) -> Column:
    """array<struct<pos int, hash bigint>>: the closed syncmers of a text, by token position.

    None for null, empty and blank texts.  A text of at most K tokens is one anchor, as a whole.
    """

    def of(tokens: Column) -> Column:
        n = F.size(tokens)
        at = lambda i, j: F.get(tokens, i + j)
        inner = lambda i: F.least(*[at(i, j) for j in range(1, K - 1)]) if K > 3 else at(i, 1)
        closed = F.filter(F.sequence(F.lit(0), n - K), lambda i: F.least(at(i, 0), at(i, K - 1)) <= inner(i))
        some = F.transform(closed, lambda i: F.struct(i.alias("pos"), _joined([at(i, j) for j in range(K)]).alias("hash")))
        zero = F.lit(0).cast("long")
        whole = F.array(F.struct(F.lit(0).alias("pos"), _joined([F.coalesce(F.get(tokens, F.lit(j)), zero) for j in range(K)]).alias("hash")))
        none = F.array().cast("array<struct<pos:int,hash:bigint>>")
        return F.when(n == 0, none).when(n <= K, whole).otherwise(some)

    return let(token_hashes(text), of)


def fingerprint(found: Column) -> Column:
    """The anchors as a string: for each, by position, one digit for the tokens since the one before
    (two at most) and 16 for its hash; "" without tokens."""
    step = lambda x, i: (x["pos"] - F.coalesce(F.get(found, i - 1)["pos"], F.lit(0))).cast("string")
    return F.array_join(F.transform(found, lambda x, i: F.concat(step(x, i), F.lpad(F.lower(F.hex(x["hash"])), 16, "0"))), "")


def read_fingerprint(found: Column) -> Column:
    """The anchors that ``fingerprint`` wrote."""
    entries = F.transform(F.sequence(F.lit(1), F.length(found), F.lit(ENTRY)), lambda i: F.substring(found, i, F.lit(ENTRY)))
    gaps = lambda x: F.transform(x, lambda e: F.substring(e, 1, 1).cast("int"))
    place = lambda g, i: F.aggregate(F.slice(g, 1, i + 1), F.lit(0), lambda acc, x: acc + x)
    read = let(entries, lambda es: let(gaps(es), lambda g: F.transform(es, lambda e, i: F.struct(place(g, i).alias("pos"), F.shiftleft(F.conv(F.substring(e, 2, 8), 16, 10).cast("long"), 32).bitwiseOR(F.conv(F.substring(e, 10, 8), 16, 10).cast("long")).alias("hash")))))
    return F.when(F.length(found) == 0, F.array().cast("array<struct<pos:int,hash:bigint>>")).otherwise(read)


def first_places(found: Column) -> Column:
    """array<struct<hash, pos>> by hash: every different anchor at its first place."""
    by_hash = F.sort_array(F.transform(found, lambda x: F.struct(x["hash"].alias("hash"), x["pos"].alias("pos"))))
    return let(by_hash, lambda z: F.filter(z, lambda x, i: (i == 0) | (F.get(z, i - 1)["hash"] != x["hash"])))


def positional_matches(a: Column, b: Column) -> Column:
    """array<struct<a int, b int>>: token positions of the anchors that two texts share.

    ``a`` and ``b`` are results of ``first_places``: two sorted arrays, merged by one sort.
    """
    side = lambda x, s: F.transform(x, lambda e: F.struct(e["hash"].alias("hash"), F.lit(s).alias("side"), e["pos"].alias("pos")))

    def pairs(z: Column) -> Column:
        twins = F.filter(F.sequence(F.lit(0), F.size(z) - 1), lambda i: F.get(z, i)["hash"] == F.get(z, i + 1)["hash"])
        return F.transform(twins, lambda i: F.struct(F.get(z, i)["pos"].alias("a"), F.get(z, i + 1)["pos"].alias("b")))

    none = F.array().cast("array<struct<a:int,b:int>>")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), none).otherwise(let(F.sort_array(F.concat(side(a, 0), side(b, 1))), pairs))


def covered(positions: Column) -> Column:
    """Tokens that k-mers at these positions cover."""
    first = F.struct(F.lit(-K).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(F.sort_array(positions), first, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(K), p - acc["last"])).alias("n")), lambda acc: acc["n"])


def likeness(a: Column, b: Column) -> Column:
    """Of the tokens that two texts' anchors cover, the share that shared anchors cover: 0 to 1.

    ``a`` and ``b`` are results of ``first_places``.  Two texts without tokens are alike (1).
    """
    whole = lambda x: covered(F.transform(x, lambda e: e["pos"]))
    shared = lambda m: covered(F.transform(m, lambda e: e["a"])) + covered(F.transform(m, lambda e: e["b"]))
    some = let(positional_matches(a, b), lambda m: F.when(F.size(m) == 0, F.lit(0.0)).otherwise(shared(m) / (whole(a) + whole(b))))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(some)


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` (doc_id, text, *columns) with next_<column> of the next row by ascending doc_id.

    The row after the last is the first.  A null id stands before all others; equal ids stand in
    the order of their texts, nulls first.  Rows are dealt to buckets of neighbouring ids whose
    edges are quantiles of the ids themselves; the first rows of a bucket are also sent, as
    guests, to the bucket before it.  So one exchange does it and no window holds the whole table.
    Buckets hold about BUCKET_CHARS, but are four times the shuffle partitions at most.
    """
    low = -(1 << 63)
    keyed = docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(low)))
    chars, least = keyed.agg(F.sum(F.coalesce(F.length("text"), F.lit(0))), F.min("_key")).first()
    if least is None:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    n = min(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(chars or 0) // BUCKET_CHARS + 1)
    edges: list[int] = []
    if n > 1:
        shares = ",".join(str(i / n) for i in range(1, n))
        found = keyed.agg(F.expr(f"percentile_approx(_key, array({shares}), {max(10_000, 20 * n)})")).first()[0]
        edges = sorted({x for x in found if x > least})
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, len(edges).bit_length())))])

    def bucket(key: Column) -> Column:
        if not edges:
            return F.lit(0)
        at = literal_longs(edges)
        return F.aggregate(steps, F.lit(0), lambda acc, step: F.when((acc + step <= len(edges)) & (F.get(at, acc + step - 1) <= key), acc + step).otherwise(acc))

    own = keyed.withColumn("_bucket", bucket(F.col("_key")))
    last = len(edges)
    place = lambda b, guest, wrap: F.struct(b.cast("int").alias("b"), F.lit(guest).alias("guest"), F.lit(wrap).alias("wrap"))
    here = place(F.col("_bucket"), False, False)
    first_row = F.col("_key") == F.lit(least)
    edge_row = F.get(literal_longs(edges), F.col("_bucket") - 1) == F.col("_key") if edges else F.lit(False)
    # every edge is an id of the table and opens its bucket, so no bucket lacks its first row
    dealt = own.withColumn("_p", F.explode(F.when(first_row, F.array(here, place(F.lit(last), True, True))).when(edge_row, F.array(here, place(F.col("_bucket") - 1, True, False))).otherwise(F.array(here))))
    order = Window.partitionBy("_p.b").orderBy("_p.wrap", "_key", F.col("text").asc_nulls_first())
    names = {c: F.lead(F.struct(c)).over(order) for c in columns}
    out = dealt.select("*", *[v.alias(f"_n_{c}") for c, v in names.items()]).where("not _p.guest")
    return out.select(*docs.columns, *[F.col(f"_n_{c}")[c].alias(f"next_{c}") for c in columns])


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n/2) characters replaced by the first as many of another."""
    text, following = F.coalesce(text, F.lit("")), F.coalesce(following, F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    Null texts count as empty: fingerprint "", and alike to another empty text.  Equal texts have
    equal fingerprints.  Repeated rows are kept; an empty table gives an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    both = with_next(own, ["text"])
    both = both.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    # every step names the columns of the last one more than once, so that each is computed once
    found = both.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        anchors(F.col("text")).alias("own"), anchors(F.col("edited")).alias("other"), anchors(F.col("next_text")).alias("following"),
    )
    placed = found.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("other")).alias("edited_fingerprint"),
        *[first_places(F.col(c)).alias(c) for c in ("own", "other", "following")],
    )
    return placed.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )

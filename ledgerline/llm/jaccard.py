"""Size-aware heavy-light Jaccard join on word shingles."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop, staged
from .common import LOWER, UPPER, joined, released
from .components import components

WORD = re.compile("[^\x20\x09-\x0d]+")
SMALL = str.maketrans(UPPER, LOWER)
#: Bits of a shingle's hash in the index; a set's size and mark go by 64.
BITS = 48
_ids: dict[str, int] = {}

MULT, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * MULT
    return x ^ (x >> np.uint64(32))


def _word_hash(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; of all its words, if there are fewer; none without words."""
    words = WORD.findall((text or "").translate(SMALL) if not (text or "").isascii() else (text or "").lower())
    if not words:
        return np.empty(0, np.uint64)
    if len(_ids) > 100_000:
        _ids.clear()
    for w in set(words).difference(_ids):
        _ids[w] = _word_hash(w)
    h = np.fromiter(map(_ids.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        out = _mixed(out + h[k : k + len(out)] + np.uint64(k + width * 8))
    return np.unique(out)


def _indexed(full: np.ndarray) -> np.ndarray:
    """The upper ``BITS`` bits, once each."""
    out = full >> np.uint64(64 - BITS)
    return out[np.concatenate([[True], out[1:] != out[:-1]])] if len(out) else out


def _packed(values: np.ndarray) -> bytes:
    """Sorted numbers as steps: 4 bytes each where all steps fit, else 8."""
    steps = np.diff(values, prepend=np.uint64(0))
    first, rest = steps[:1], steps[1:]
    if len(rest) and int(rest.max()) < 1 << 32:
        return b"\x04" + first.tobytes() + rest.astype("<u4").tobytes()
    return b"\x08" + steps.tobytes()


def _six(tokens: np.ndarray) -> bytes:
    """48-bit numbers, 6 bytes each, in their order."""
    return tokens.astype("<u8").view("u1").reshape(-1, 8)[:, :6].tobytes()


def _from_six(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), "u1")
    out[:, :6] = np.frombuffer(blob, "u1").reshape(-1, 6)
    return out.view("<u8")[:, 0]


def _unpacked(blob: bytes) -> np.ndarray:
    if blob[0] == 4:
        return np.cumsum(np.concatenate([np.frombuffer(blob, "<u8", 1, 1), np.frombuffer(blob, "<u4", offset=9).astype(np.uint64)]), dtype=np.uint64)
    return np.cumsum(np.frombuffer(blob, "<u8", offset=1), dtype=np.uint64)


ENTRIES = "batch long, bucket int, tokens binary, owners binary"


def _token_blocks(buckets: int, width: int, most_docs: int = 2048):
    """Blocks of the inverted index: for each batch of documents and each range of hashes, its sorted tokens and the places of the documents they are in; and one block (bucket -1 or less) of the documents themselves. Of equal sets in a batch only one is indexed."""
    shift = np.uint64(BITS) - np.uint64(buckets.bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        for whole in batches:
            for start in range(0, len(whole), most_docs):
                pdf = whole.slice(start, most_docs)
                sets = [shingles(t.as_py(), width) for t in pdf["text"]]
                sizes = np.array([len(s) for s in sets], np.int64)
                marks = np.array([[_mixed(s).sum(dtype=np.uint64), _mixed(s ^ MULT).sum(dtype=np.uint64)] for s in sets], np.uint64).reshape(-1, 2)
                docs = pd.DataFrame({"doc": pdf["doc"].fill_null(0).to_numpy(), "unnamed": pdf["doc"].is_null().to_numpy(False), "n": sizes, "mark": marks[:, 0].astype(np.int64), "check": marks[:, 1].astype(np.int64)})
                first = ~docs.duplicated(["unnamed", "n", "mark", "check"]).to_numpy() & (sizes > 0) & ~docs.unnamed.to_numpy()
                rows = [(place, -1 - place % buckets, _frame(docs), b"")]
                if first.any():
                    parts = [_indexed(s) for s, f in zip(sets, first, strict=True) if f]
                    tokens = np.concatenate(parts)
                    owners = np.repeat(np.flatnonzero(first), [len(p) for p in parts]).astype("<u2")
                    order = np.argsort(tokens, kind="stable")
                    tokens, owners = tokens[order], owners[order]
                    cuts = np.searchsorted(tokens >> shift, np.arange(buckets + 1))
                    rows += [(place, k, _packed(tokens[a:b]), owners[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["batch", "bucket", "tokens", "owners"])
                place += 1
        _ids.clear()
        whole = pdf = sets = parts = tokens = owners = order = rows = None
        released()

    return run


def _frame(pdf: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    t = pa.Table.from_pandas(pdf, preserve_index=False)
    with pa.ipc.new_stream(sink, t.schema) as out:
        out.write_table(t)
    return sink.getvalue().to_pybytes()


def _unframe(blob: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(blob).read_all().to_pandas()


def _common(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket's tokens those in two documents or more, with their document frequency, in a block for each batch. Blocks of documents pass."""
    if pdf.bucket.iloc[0] < 0:
        return pdf[["batch", "tokens", "owners"]].assign(dfs=b"")
    parts = [_unpacked(t) for t in pdf.tokens]
    tokens = np.concatenate(parts)
    _, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    df = np.minimum(counts, 0xFFFFFFFF).astype("<u4")[inverse]
    rows, at = [], 0
    for batch, part, owners in zip(pdf.batch, parts, pdf.owners, strict=True):
        own = df[at : at + len(part)]
        keep = own >= 2
        if keep.any():
            rows.append((batch, _packed(part[keep]), np.frombuffer(owners, "<u2")[keep].tobytes(), own[keep].tobytes()))
        at += len(part)
    del parts, tokens, inverse, counts, df
    released()
    return pd.DataFrame(rows, columns=["batch", "tokens", "owners", "dfs"])


def _assembled(share: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """A batch's documents, each with its common tokens, rarest first; without them, where they are too few for any link, or an equal set of the batch has them."""
        head = pdf.dfs.str.len() == 0
        docs = _unframe(pdf.tokens[head].iloc[0])
        docs["common"] = [b""] * len(docs)
        rest = pdf[~head]
        if len(rest):
            tokens = np.concatenate([_unpacked(t) for t in rest.tokens])
            owners = np.concatenate([np.frombuffer(o, "<u2") for o in rest.owners])
            dfs = np.concatenate([np.frombuffer(d, "<u4") for d in rest.dfs])
            order = np.lexsort((tokens, dfs, owners))
            tokens, owners = tokens[order], owners[order]
            cuts = np.searchsorted(owners, np.arange(len(docs) + 1))
            enough = 100 * np.diff(cuts) >= share * docs.n.to_numpy()
            docs["common"] = [_six(tokens[a:b]) if e and b > a else b"" for a, b, e in zip(cuts, cuts[1:], enough, strict=False)]
            del tokens, owners, dfs, order
            released()
        return docs

    return run


def documents(df: DataFrame, key: str, text: str, share: int = 75, width: int = 5) -> DataFrame:
    """(doc, n, mark, check, common): set size, a 128-bit mark of the set, and the tokens that other documents have too, rarest first, as 6-byte numbers: none where they are fewer than ``share`` hundredths of the set, since it can't be linked then, and where an equal set at hand has them."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = 1 << max(3, (int(size) // 4_000_000).bit_length())
    blocks = df.select(F.col(key).alias("doc"), F.col(text).alias("text")).mapInArrow(_token_blocks(buckets, width), ENTRIES)
    common = blocks.groupBy("bucket").applyInPandas(_common, "batch long, tokens binary, owners binary, dfs binary")
    out = common.groupBy("batch").applyInPandas(_assembled(share), "doc long, unnamed boolean, n long, mark long, check long, common binary")
    return out.select(F.when(~F.col("unnamed"), F.col("doc")).alias("doc"), "n", "mark", "check", "common")


def _needed(n, share: int):
    """Least size of the intersection of a set of n with one it is linked with."""
    return -(-share * n // 100)


def _boundary(histogram: list, share: int, mates: float, pair_cost: float = 0.5) -> int:
    """The size up to which 2-subsets are cheaper than inverted lists: subsets cost a row each; an entry in a list costs a row and ``pair_cost`` for each of its ``mates``. Both by the sizes that the sets have."""
    best = 0
    for n, c, _ in histogram:
        light = max(0, c - _needed(n, share) + 2)
        if light * (light - 1) / 2 <= (light - 1) * (1 + pair_cost * mates):
            best = n
        else:
            break
    return best


KEYS = "key long, rep long, n long, c long, at long, light boolean"


def _keys(share: int, boundary: int, components: bool = False):
    """The keys under which a set is looked up. A set of n with c common tokens shares ``o = ceil(share * n)`` with any partner, so two partners share one of their first c - o + 1 common tokens (rarest first), and two of their first c - o + 2. Light sets (n <= boundary) give the 2-subsets of the latter, for each other; heavy ones, and light ones that can be a heavy one's partner, the former."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rep, n, blob, component in zip(pdf.rep, pdf.n, pdf.common, pdf.component if components else pdf.rep, strict=True):
                t = _from_six(blob)
                slack = len(t) - _needed(n, share)
                if slack < 0:
                    continue
                if n <= boundary:
                    p = t[: slack + 2]
                    i, j = np.triu_indices(len(p), 1)
                    # the first of the two in the order is the earlier one for both partners
                    out.append(pd.DataFrame({"key": _mixed(_mixed(p[i]) + p[j]).view(np.int64), "rep": rep, "n": n, "c": len(t), "at": i, "light": True, "component": component}))
                if n > boundary or 100 * n >= share * (boundary + 1):
                    p = t[: slack + 1]
                    out.append(pd.DataFrame({"key": p.view(np.int64), "rep": rep, "n": n, "c": len(t), "at": np.arange(len(p)), "light": False, "component": component}))
            if out:
                yield pd.concat(out) if components else pd.concat(out).drop(columns="component")
        pdf = out = None
        released()

    return run


def _linkable(a: str, b: str, share: int):
    """Sizes within the bound, and the key's places leave enough common tokens: a link needs ``share * (n + n') / (100 + share)`` common ones. The key is the first that both have for at least one key of each link."""
    at, bt = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    rest = F.least(at("c") - at("at"), bt("c") - bt("at"))
    return (at("n") * share <= bt("n") * 100) & (bt("n") * share <= at("n") * 100) & (rest * (100 + share) >= (at("n") + bt("n")) * share)


def _overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(np.intersect1d(_from_six(x), _from_six(y), assume_unique=True)) for x, y in zip(a, b, strict=True)], dtype="int64")


def _verified(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    overlap = F.pandas_udf(_overlap, "long")
    left = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("common").alias("ca"))
    right = sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("common").alias("cb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", overlap("ca", "cb").alias("o"))
    return both.filter(100 * F.col("o") >= share * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def similar_groups(df: DataFrame, key: str = "doc_id", text: str = "text", share: int = 75, width: int = 5) -> DataFrame:
    """(key, n_shingles, component_id): documents joined where ``100 * |A & B| >= share * |A | B|``, and what is reachable.

    Equal sets are one class, whose smallest key stands for it; classes without words, or whose tokens mostly occur
    nowhere else, are linked with nothing. Candidates come from light sets' 2-subsets and heavy sets' inverted lists. First, each list's most
    common set is verified against the list (a star: as many pairs as entries), which joins groups of near copies; then
    all pairs in a list that aren't in one component yet. So no link between components is lost, and pairs within
    a group of copies aren't formed. Set sizes count 64-bit hashes, the index holds 48 bits of them, and sets are matched by 128 bits. Keys and classes that hold more than a thousandth of the rows are joined by broadcast, and a list's pairs are dealt out by thousands. Keys are integers: rows with a null key keep it, and join nothing. Repeated rows
    give repeated rows."""
    wide = staged(documents(df, key, text, share, width), "sets")
    # a class's common tokens are the same wherever they are given
    classes = wide.filter((F.col("n") > 0) & F.col("doc").isNotNull()).groupBy("n", "mark", "check").agg(F.max("common").alias("common"), F.min("doc").alias("rep"), F.count("*").alias("k"))
    classes = staged(classes, "set-classes")
    docs = staged(wide.drop("common"), "set-sizes")
    drop(wide)
    sets = classes.filter(F.octet_length("common") > 0).select("rep", "n", "common")
    # a row for each size: at most as many as the largest set has tokens, in the range that light sets may have
    sizes = sets.filter(F.col("n") <= 400).groupBy("n").agg(F.max(F.octet_length("common") / 6).cast("long").alias("c"), F.count("*").alias("rows")).orderBy("n").collect()
    rows, lists = sets.mapInPandas(_keys(share, 0), KEYS).agg(F.count("*"), F.approx_count_distinct("key")).first()
    boundary = _boundary([(r["n"], r["c"], r["rows"]) for r in sizes], share, rows / max(1, lists))
    keys = staged(sets.mapInPandas(_keys(share, boundary), KEYS), "set-keys")
    # a key of one set has no candidates
    hub = F.max(F.struct((F.col("c") / F.col("n")).alias("r"), -F.col("rep"), "rep", "n", "c", "at")).alias("x")
    hubs = staged(keys.groupBy("key", "light").agg(hub, F.count("*").alias("k")).filter(F.col("k") > 1), "key-hubs")
    star = joined(keys.select("key", "light", "rep", F.struct("rep", "n", "c", "at").alias("y")), hubs, ["key", "light"])
    star = star.filter((F.col("x.rep") != F.col("y.rep")) & _linkable("x", "y", share) & (F.col("light") | (F.col("x.n") > boundary) | (F.col("y.n") > boundary)))
    pairs = star.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
    edges = staged(_verified(pairs, sets, share), "star-links")
    drop(keys, hubs)
    labels = components(edges)
    # keys are made again with their components, which is less than to join them
    named = sets.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = named.mapInPandas(_keys(share, boundary, True), KEYS + ", component long")
    spread_keys = named.groupBy("key", "light").agg(F.min("component").alias("p"), F.max("component").alias("q"), F.count("*").alias("k")).filter(F.col("p") != F.col("q"))
    spread_keys = staged(spread_keys.select("key", "light", F.ceil(F.col("k") / 1000).alias("salts")), "open-keys")
    few = spread_keys.count() <= 100_000  # 2.4 MB at most
    opened = staged(named.join(F.broadcast(spread_keys) if few else spread_keys, ["key", "light"]), "open-rows")
    # a list of many sets is dealt to as many tasks as it has thousands
    x = opened.withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts"))).alias("x")
    y = opened.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).alias("y")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.light") == F.col("y.light")) & (F.col("x.salt") == F.col("y.salt"))
    heavy = F.col("x.light") | (F.col("x.n") > boundary) | (F.col("y.n") > boundary)
    rest = x.join(y, same & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.component") != F.col("y.component")) & _linkable("x", "y", share) & heavy)
    pairs = rest.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    more = staged(_verified(pairs, sets, share), "rest-links")
    drop(opened, spread_keys)
    labels = components(edges.unionByName(more))
    drop(edges, more)
    classes = classes.select("n", "mark", "check", "rep", "k").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("n", "mark", "check", "k", F.coalesce("component", "rep").alias("component"))
    named = joined(docs.select("doc", "n", "mark", "check"), staged(classes, "class-components"), ["n", "mark", "check"], how="left")
    return named.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component_id"))

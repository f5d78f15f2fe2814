r"""N-gram Jaccard join by filters under several global token orders (operator 6).

A document's tokens are the 64-bit hashes of its distinct shingles of SHINGLE words
[^\x20\x09-\x0D]+, A-Z lower-cased. If two sets have a similarity of PART / WHOLE or more, they
share a token among the first n - ceil(n * PART / WHOLE) + 1 of each, under any order of all
tokens. The orders are:

A. by hash. If two sets are alike, their prefixes longer by l - 1 tokens share l. Buckets send
   each distinct token of such longer prefixes once; documents of whose tokens there fewer are
   in other documents than any partner would share leave. So do most that share a passage only.
B. rarest first, by the number of remaining documents that have the token, then by hash.
   Tokens that very many documents have come last, so they seldom are in a prefix. A token's
   place in the set limits the sizes of possible partners, and entries that no partner fits
   are dropped.
C. by falling hash.

Candidates come from order B and must share prefix tokens under A and C as well before their
sets are intersected. Pairs inside a bucket are decided there. Between buckets, each token's
documents are linked like a chain first, and components of the links found make pairs of one
component needless. Of a token that at most FEW documents have besides its largest component,
all pairs of different components follow. The documents of other tokens are near copies, or share most of a passage;
they are held against one of them and divided by the tokens in which they differ from it (see
_recentred), again and again, so their pairs are never made. No link between different texts
is lost. Equal sets are one set.

Cases: a null text, or one without words, has no tokens and is linked with nothing; a text of
fewer words than a shingle is one token; a null id takes no part in links and keeps its row;
rows that repeat an id are linked as one node, with the shingle count of their own text; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as an
from .blocks import LOWER, NULL_ID, Bucket, bucket_count, bucketed, checkpointed, ensure_checkpoint_dir, grouped, hashes_of, pack, part_count, ranges, small, space_words, unpack
from .components import Union, components

SHINGLE, PART, WHOLE = 5, 75, 100
BUCKET_BYTES = 8 << 20
#: The share of its least overlap that a set must find in other sets' longer prefixes, as 1 / LONGER.
LONGER = 6
#: Documents of a group outside its largest component: if there are so many at most, they are
#: tried with all of the group, which is FEW pairs a document (FEW_DIVIDED in what a division has
#: left, as those groups are small); else the group is divided by what its documents differ in.
#: After TURNS divisions all pairs of what is left are tried.
FEW, FEW_DIVIDED, TURNS = 8, 256, 6
#: Members of a hub that one part holds, and tokens of their sets, on average; differences whose
#: number one slice of a hub's tokens counts.
DEALT, DEALT_TOKENS, SLICE = 64, 1 << 20, 1 << 14
U64 = np.uint64
_MESSAGE = "part int, bucket int, data binary"


def tokens(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted hashes, of 48 bits, of a text's distinct tokens, which 64 bits tell apart."""
    words = space_words(text.translate(LOWER))
    if not words:
        return np.zeros(0, U64)
    return np.sort(np.unique(an.kgrams(hashes_of(words), min(shingle, len(words))) ^ U64(min(shingle, len(words)) << 1)) & an.LOW48)


def prefix(n: int, part: int, whole: int) -> int:
    return n - -(-n * part // whole) + 1 if n else 0


def needed(n: int, part: int, whole: int) -> int:
    """Tokens that a set of n tokens shares with any partner within both longer prefixes."""
    return max(1, -(-n * part // whole) // LONGER)


def longer_prefix(n: int, part: int, whole: int) -> int:
    """As long as the largest possible partner of a set of n tokens needs it."""
    return min(n, prefix(n, part, whole) - 1 + needed(n * whole // part, part, whole)) if n else 0


def partners(n, place, part: int, whole: int):
    """The least and the greatest size of a partner of a set of n tokens that has the first token
    in common at this place: at most n - place tokens are shared, and part / (part + whole) of
    both sizes at least."""
    return -(-n * part // whole), np.minimum((n - place) * (part + whole) // part - n, n * whole // part)


def similar(x: np.ndarray, y: np.ndarray, part: int, whole: int) -> bool:
    """Whether sorted sets are alike; prefixes under orders A and C are tried first."""
    p, q = prefix(len(x), part, whole), prefix(len(y), part, whole)
    if min(len(x), len(y)) * whole < part * max(len(x), len(y)):
        return False
    if not (_meet(x[:p], y[:q]) and _meet(x[-p:], y[-q:])):
        return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared * whole >= part * (len(x) + len(y) - shared)


def _meet(x: np.ndarray, y: np.ndarray) -> bool:
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return bool((y[at] == x).any())


class Sets:
    """The token sets of a bucket: each distinct one once, with the least id that has it."""

    def __init__(self, bucket: Bucket, shingle: int):
        self.n: list[int] = []  # of each row
        self.of: list[int] = []  # of each row: its set, -1 without tokens
        self.sets: list[np.ndarray] = []
        self.prints: list[bytes] = []
        self.doc: list[int] = []
        seen: dict[bytes, int] = {}
        for doc, text in zip(bucket.ids.tolist(), bucket.texts, strict=True):
            t = tokens(text.as_buffer().to_pybytes(), shingle)
            self.n.append(len(t))
            if not len(t) or doc == NULL_ID:
                self.of.append(-1)
                continue
            key = xxhash.xxh3_128_digest(t.tobytes())
            if key not in seen:
                seen[key] = len(self.sets)
                self.sets.append(t)
                self.prints.append(key)
                self.doc.append(doc)
            self.of.append(seen[key])


def _counted(bucket: int, h: np.ndarray, parts: int) -> pa.Table:
    """Messages of a bucket: its distinct tokens, and how many of its sets have each."""
    if not len(h):
        return an.spans_table([], [], [])
    h = np.sort(h)
    begin, _ = grouped(h)
    n = np.diff(np.r_[begin, len(h)])
    return an._dealt(bucket, h[begin], parts, n=an.narrow(n))


def _first(parts: int, shingle: int, part: int, whole: int):
    def send(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
        s = Sets(Bucket(docs), shingle)
        return _counted(key[0].as_py(), np.concatenate([x[: longer_prefix(len(x), part, whole)] for x in s.sets] or [np.zeros(0, U64)]), parts)

    return send


def _remaining(s: Sets, shared: an.Shared, part: int, whole: int) -> list[int]:
    """Sets that may have a partner by the longer prefixes under A; copies of a set in other buckets count."""
    return [i for i, x in enumerate(s.sets) if np.count_nonzero(shared(x[: longer_prefix(len(x), part, whole)])[0]) >= needed(len(x), part, whole)]


#: What the second step leaves: of each document its id, number of tokens and, with candidates,
#: its set's fingerprint (kind 0); the sets that remain, with the least id of the bucket that has
#: each (kind 1); and for each part the bucket's tokens (kind 2: the part as n).
SECOND = "kind int, bucket int, doc long, n int, print binary, data binary"


def _second(parts: int, shingle: int, part: int, whole: int):
    def send(key: tuple[pa.Scalar, ...], docs: pa.Table, shared: pa.Table) -> pa.Table:
        bucket = Bucket(docs)
        s = Sets(bucket, shingle)
        keep = _remaining(s, an.Shared(shared), part, whole)
        number = (docs if docs.num_rows else shared)["bucket"][0].as_py()
        sent = _counted(number, np.concatenate([s.sets[i] for i in keep] or [np.zeros(0, U64)]), parts)
        n, k, m = len(bucket), len(keep), sent.num_rows
        kind = np.repeat(np.array([0, 1, 2], np.int32), [n, k, m])
        doc = pa.chunked_array([bucket.doc_id.combine_chunks() if isinstance(bucket.doc_id, pa.ChunkedArray) else bucket.doc_id, pa.array([s.doc[i] for i in keep], pa.int64()), pa.nulls(m, pa.int64())])
        size = pa.array([*s.n, *[len(s.sets[i]) for i in keep], *sent["part"].to_pylist()], pa.int32())
        prints = pa.array([*[s.prints[j] if j >= 0 else None for j in s.of], *[None] * (k + m)], pa.binary())
        data = pa.array([*[None] * n, *[pack(**an.split48(s.sets[i])) for i in keep], *sent["data"].to_pylist()], pa.binary())
        return pa.table([pa.array(kind), pa.array(np.full(n + k + m, number, np.int32)), doc, size, prints, data], ["kind", "bucket", "doc", "n", "print", "data"])

    return send


def _frequencies(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """To each bucket, its tokens that two sets have, with the bits of their number."""
    buckets = table["bucket"].to_numpy()
    sent = [unpack(x) for x in table["data"].to_pylist()]
    h = np.concatenate(list(map(an.join48, sent)))
    n = np.concatenate([x["n"] for x in sent]).astype(np.int64)
    of = np.repeat(np.arange(len(sent)), [len(x["lo"]) for x in sent])
    order = np.argsort(h, kind="stable")
    begin, run = grouped(h[order])
    total = np.add.reduceat(n[order], begin)[run]
    keep = total >= 2
    order, total = order[keep], total[keep]
    by = np.argsort(of[order], kind="stable")
    order, total = order[by], total[by]
    each = ranges(of[order])
    bits = np.minimum(np.log2(total) * 8, 255).astype(np.uint8)
    return pa.table({"bucket": pa.array([buckets[of[order[a]]] for a, _ in each], pa.int32()), "data": pa.array([pack(**an.split48(h[order[a:b]]), n=bits[a:b]) for a, b in each], pa.binary())})


#: Links inside the bucket (kind 2: two ids); all entries of a bucket's tokens (kind 3: tokens,
#: ids, sizes, sizes of partners), and for each part those of its tokens, one for each
#: component inside the bucket (kind 4: the part as n).
THIRD = "kind int, a long, b long, n int, data binary"


def _third(parts: int, part: int, whole: int):
    def send(key: tuple[pa.Scalar, ...], remaining: pa.Table, told: pa.Table) -> pa.Table:
        remaining = remaining.sort_by("doc")
        docs = remaining["doc"].to_pylist()
        sets = [an.join48(unpack(x)) for x in remaining["data"].to_pylist()]
        got = [unpack(x) for x in told["data"].to_pylist()]
        h = np.concatenate(list(map(an.join48, got))) if got else np.zeros(0, U64)
        f = np.concatenate([x["n"] for x in got]) if got else np.zeros(0, np.uint8)
        order = np.argsort(h)
        h, f = h[order], f[order]
        entries: list[tuple[np.ndarray, ...]] = []
        for i, x in enumerate(sets):
            if not len(h):
                break
            n = len(x)
            at = np.minimum(np.searchsorted(h, x), len(h) - 1)
            freq = np.where(h[at] == x, f[at], 0)
            shared = np.flatnonzero(freq > 0)
            shared = shared[np.argsort(freq[shared], kind="stable")]  # x is in the order of the hash
            place = np.arange(n - len(shared), n)  # tokens of this set alone come first
            inside = place < prefix(n, part, whole)
            shared, place = shared[inside], place[inside]
            least, most = partners(np.int64(n), place, part, whole)
            ok = most >= least
            if ok.any():
                k = int(ok.sum())
                entries.append((x[shared[ok]], np.full(k, i), np.full(k, n), np.full(k, least), most[ok], place[ok]))
        rows: dict[str, list] = {c: [] for c in ("kind", "a", "b", "n", "data")}

        def add(kind: int, a=None, b=None, n=None, data=None) -> None:
            for c, v in zip(rows, (kind, a, b, n, data), strict=True):
                rows[c].append(v)

        if entries:
            t, i, n, least, most, place = (np.concatenate(c) for c in zip(*entries, strict=True))
            order = np.lexsort((i, n, t))
            t, i, n, least, most, place = (c[order] for c in (t, i, n, least, most, place))
            near = (t[1:] == t[:-1]) & (n[:-1] >= least[1:]) & (n[1:] <= most[:-1])
            union = Union()
            tried: set[tuple[int, int]] = set()
            for x, y in zip(i[:-1][near].tolist(), i[1:][near].tolist(), strict=True):
                if (x, y) not in tried and union.root(x) != union.root(y):
                    tried.add((x, y))
                    if similar(sets[x], sets[y], part, whole):
                        union.join(x, y)
                        add(2, docs[x], docs[y])
            size = np.fromiter(map(len, sets), np.int32, len(sets))
            entry = {"t": t, "i": i, "place": place}
            add(3, data=_packed(entry, docs, size))
            root = np.fromiter(map(union.root, i.tolist()), np.int64, len(i))
            order = np.lexsort((root, t))
            one = order[np.r_[True, (t[order][1:] != t[order][:-1]) | (root[order][1:] != root[order][:-1])]]
            for to, r in an.by_part(0, an.part_of(t[one], parts)):
                add(4, n=to, data=_packed({c: v[one[r]] for c, v in entry.items()}, docs, size))
        return pa.table([pa.array(rows["kind"], pa.int32()), pa.array(rows["a"], pa.int64()), pa.array(rows["b"], pa.int64()), pa.array(rows["n"], pa.int32()), pa.array(rows["data"], pa.binary())], list(rows))

    return send


def _packed(entry: dict[str, np.ndarray], docs: list[int], size: np.ndarray) -> bytes:
    """Entries sorted by token; documents and their sizes are named once."""
    used, i = np.unique(entry["i"], return_inverse=True)
    return pack(**an.split48(entry["t"]), i=i.astype(np.uint32), place=entry["place"].astype(np.uint32), doc=np.array(docs, np.int64)[used], n=size[used])


def _unpacked(data: bytes, part: int, whole: int) -> dict[str, np.ndarray]:
    """t, doc, n, place, and the least and most: the sizes of possible partners."""
    x = unpack(data)
    n, place = x["n"][x["i"]].astype(np.int64), x["place"].astype(np.int64)
    least, most = partners(n, place, part, whole)
    return {"t": an.join48(x), "doc": x["doc"][x["i"]], "n": n, "place": place, "least": least, "most": most}


def _chain(part: int, whole: int):
    """Of each token's sets, those next to each other in size, as pairs of ids."""

    def chain(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sent = [_unpacked(x, part, whole) for x in table["data"].to_pylist()]
        t, doc, n, least, most = (np.concatenate([x[c] for x in sent]) for c in ("t", "doc", "n", "least", "most"))
        order = np.lexsort((doc, n, t))
        t, doc, n, least, most = (c[order] for c in (t, doc, n, least, most))
        near = (t[1:] == t[:-1]) & (doc[1:] != doc[:-1]) & (n[:-1] >= least[1:]) & (n[1:] <= most[:-1])
        pairs = np.unique(np.sort(np.stack([doc[:-1][near], doc[1:][near]], axis=1), axis=1), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return chain


def _entries(part: int, whole: int):
    """As entries of a first group each: its token; of each document the excess of all tokens."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch["data"].to_pylist():
                e = _unpacked(x, part, whole)
                excess = e["n"] * 2 * part
                columns = [e["t"].astype(np.int64), e["doc"], e["n"].astype(np.int32), excess, (e["n"] - e["place"]).astype(np.int32), np.ones(len(excess), bool), np.zeros(len(excess), np.int32)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ENTRY)

    return entries


def _decide(part: int, whole: int):
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [similar(an.join48(unpack(x)), an.join48(unpack(y)), part, whole) for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(same, pa.bool_()))

    return decide


ENTRY = ["g", "doc", "n", "excess", "room", "far", "kind"]


def _between(entries: DataFrame, inner: DataFrame) -> DataFrame:
    """Entries of groups of several components, with their component c and `others`, how many of
    the group's documents are not of its largest component, which is `top`. Groups of the second kind need both
    near and far ones."""
    entries = entries.select(ENTRY).join(inner.withColumnRenamed("node", "doc"), "doc", "left").withColumn("c", F.coalesce("component", "doc")).drop("component")
    each = entries.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("lo"), F.max("far").alias("hi"), F.max("kind").alias("kind"))
    mixed = each.groupBy("g").agg((F.sum("n") - F.max("n")).alias("others"), F.max_by("c", "n").alias("top"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("kind").alias("kind"))
    mixed = mixed.where("others > 0 and hi and (kind = 0 or not lo)").select("g", "others", "top")
    return checkpointed(entries.join(mixed, "g"))


def _pairs(entries: DataFrame, part: int, whole: int) -> DataFrame:
    """All pairs a, b of a group that are of different components and may be similar."""
    other = entries.select("g", *[F.col(x).alias(f"{x}_2") for x in ("doc", "c", "excess", "room", "far")])
    shared = 2 * (part + whole) * F.least("room", "room_2")
    met = entries.join(other, "g").where((F.col("c") < F.col("c_2")) & (F.col("far") | F.col("far_2")) & (F.col("excess") + F.col("excess_2") <= shared))
    return met.select(F.col("doc").alias("a"), F.col("doc_2").alias("b")).distinct()


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each member its size and the tokens in which it differs from its hub."""
    for batch in batches:
        hubs = {k: an.join48(unpack(d)) for k, d in dict(zip(batch["hub"].to_pylist(), batch["h"].to_pylist(), strict=True)).items()}
        out, size = [], []
        for k, d in zip(batch["hub"].to_pylist(), batch["x"].to_pylist(), strict=True):
            x = an.join48(unpack(d))
            out.append(np.setxor1d(x, hubs[k], assume_unique=True).astype(np.int64))
            size.append(len(x))
        at = np.zeros(len(out) + 1, np.int32)
        np.cumsum([len(x) for x in out], out=at[1:])
        tokens = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(out or [np.zeros(0, np.int64)])))
        yield pa.RecordBatch.from_arrays([batch["hub"], batch["deal"], batch["doc"], batch["own"], batch["c"], pa.array(size, pa.int32()), tokens], ["hub", "deal", "doc", "own", "c", "n", "tokens"])


def _listed(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and how many each has."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(U64), np.diff(lists.offsets.to_numpy())


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each slice of a hub's tokens the parts' distinct ones: how many members have each, the
    least and greatest of their components, and whether one is far."""
    for batch in batches:
        t, long = _listed(batch["tokens"])
        hub, deal, slices, c, far = (np.repeat(batch[x].to_numpy(zero_copy_only=False), long) for x in ("hub", "deal", "slices", "c", "far"))
        if not len(t):
            continue
        at = (t % slices.astype(U64)).astype(np.int32)
        order = np.lexsort((t, at, deal, hub))
        hub, deal, at, t, c, far = (x[order] for x in (hub, deal, at, t, c, far))
        new = np.concatenate([[True], (hub[1:] != hub[:-1]) | (deal[1:] != deal[:-1]) | (at[1:] != at[:-1])])
        begin = np.flatnonzero(new | np.concatenate([[True], t[1:] != t[:-1]]))
        n, lo, hi, far = np.diff(np.append(begin, len(t))), np.minimum.reduceat(c, begin), np.maximum.reduceat(c, begin), np.maximum.reduceat(far, begin)
        first = np.flatnonzero(new[begin])
        parts = zip(first, np.append(first[1:], len(begin)), strict=True)
        data = [pack(**an.split48(t[begin[a:b]]), n=an.narrow(n[a:b]), least=lo[a:b], most=hi[a:b], far=far[a:b].astype(np.uint8)) for a, b in parts]
        first = begin[first]
        yield pa.RecordBatch.from_arrays([pa.array(hub[first]), pa.array(deal[first]), pa.array(at[first]), pa.array(data, pa.binary())], ["hub", "deal", "slice", "data"])


def _merged(table: pa.Table) -> tuple[list[dict], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Messages; their tokens, an order of these by value, and where each distinct one begins and
    which of those each is, in that order."""
    sent = [unpack(x) for x in table["data"].to_pylist()]
    t = np.concatenate(list(map(an.join48, sent)))
    order = np.argsort(t, kind="stable")
    return sent, t, order, *grouped(t[order])


def _moved(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Tokens in which more than half of the members differ from their hub."""
    sent, t, order, begin, _ = _merged(table)
    votes = np.add.reduceat(np.concatenate([x["n"] for x in sent])[order].astype(np.int64), begin)
    most = t[order][begin][2 * votes > table["members"][0].as_py()].astype(np.int64)
    return pa.table({"hub": pa.array([key[0].as_py()], pa.int64()), "moved": pa.array([most], pa.list_(pa.int64()))})


def _often(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """To each part, how many members have those of its tokens that are of several components and
    of a far member."""
    sent, t, order, begin, run = _merged(table)
    of = np.repeat(np.arange(len(sent)), [len(x["lo"]) for x in sent])
    n, lo, hi, far = (f.reduceat(np.concatenate([x[c] for x in sent])[order].astype(np.int64), begin) for f, c in ((np.add, "n"), (np.minimum, "least"), (np.maximum, "most"), (np.maximum, "far")))
    keep = ((lo < hi) & (far > 0))[run]
    order, n = order[keep], n[run][keep]
    by = np.argsort(of[order], kind="stable")
    order, n = order[by], n[by]
    each = ranges(of[order])
    deal = table["deal"].to_numpy()
    data = [pack(**an.split48(t[order[a:b]]), often=an.narrow(n[a:b])) for a, b in each]
    hub = pa.array(np.full(len(data), key[0].as_py(), np.int64))
    return pa.table({"hub": hub, "deal": pa.array(np.array([deal[of[order[a]]] for a, _ in each], np.int32)), "data": pa.array(data, pa.binary())})


def _placed(key: tuple[pa.Scalar, ...], members: pa.Table, told: pa.Table) -> pa.Table:
    """Entries of new groups: of each member the tokens that leave room for as many shared ones as
    a partner needs, the rarest first. Far members meet in kind 0, far and near ones in kind 1."""
    sent = [unpack(x) for x in told["data"].to_pylist()]
    known, often = np.concatenate([np.zeros(0, U64), *map(an.join48, sent)]), np.concatenate([np.zeros(0, np.int64), *[x["often"] for x in sent]]).astype(np.int64)
    known, first = np.unique(known, return_index=True)
    often = often[first]
    t, long = _listed(members["tokens"]) if members.num_rows else (np.zeros(0, U64), np.zeros(0, np.int64))
    row = np.repeat(np.arange(len(long)), long)
    shared = np.isin(t, known)
    t, row = t[shared], row[shared]
    often = often[np.searchsorted(known, t)]
    order = np.lexsort((t, often, row))
    t, row = t[order], row[order]
    # tokens of one component alone come first, so as many as are shared are left at the first shared one
    count = np.bincount(row, minlength=len(long))
    room = np.repeat(np.cumsum(count), count) - np.arange(len(row))
    value = lambda c: members[c].to_numpy()
    far, with_far, with_near = value("far").astype(bool), value("with_far"), members["with_near"].fill_null(0).to_numpy()
    ok = [far[row] & (room >= with_far[row]), room >= np.where(far, with_near, with_far)[row]]
    at, kind = np.concatenate([np.flatnonzero(x) for x in ok]), np.repeat(np.arange(2, dtype=np.int32), [np.count_nonzero(x) for x in ok])
    row, t, room = row[at], t[at], room[at]
    hub = np.full(len(at), key[0].as_py(), np.int64)
    columns = [hub, t.astype(np.int64), value("doc")[row], value("n").astype(np.int32)[row], value("excess")[row], room.astype(np.int32), far[row], kind]
    return pa.table(list(map(pa.array, columns)), ["hub", "token", "doc", "n", "excess", "room", "far", "kind"])


def _recentred(entries: DataFrame, sets: DataFrame, turn: int, part: int, whole: int) -> tuple[DataFrame, DataFrame]:
    """Links, and entries of new groups, for groups too large for all their pairs.

    One of a group's documents, of about the others' size, is its hub, and the hub's set, with
    the members' votes on each token, its centre. With D(x) the tokens in which x differs from
    the centre, x and y differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)| tokens. So they are similar if excess(x) + excess(y) is at most 2 (part + whole) |D(x) & D(y)|. Documents
    near enough to that of least excess are linked with it. Any other pair must share tokens in
    which both differ from the centre. Those are rare among the members, and prefixes of them, the
    rarest first, make the new groups."""
    step = 2 * (part + whole)
    # a class of sizes spans four times what partners may differ by; one near its upper end is in the next, too
    sized = F.log(F.col("n").cast("double")) / (4 * float(np.log(whole / part)))
    both = F.array_distinct(F.array(F.floor(sized).cast("int"), F.floor(sized + 0.2500001).cast("int")))
    classed = entries.select("g", "doc", "n", "c", F.explode(both).alias("class"))
    hubs = classed.groupBy("g", "class").agg(F.min(F.struct(F.xxhash64("doc", F.lit(turn)).alias("h"), "doc")).alias("hub")).select("g", "class", F.col("hub.doc").alias("hub"))
    members = checkpointed(classed.join(hubs, ["g", "class"]).groupBy("hub", "doc", "c").agg(F.max("n").alias("n")))
    # a hub has its members in as many parts as they fill, and what is said of it goes to each part
    parts = small(members.groupBy("hub").agg(F.ceil(F.greatest(F.count(F.lit(1)) / DEALT, F.sum("n") / DEALT_TOKENS)).cast("int").alias("parts")))
    members = members.join(parts, "hub").withColumn("deal", F.pmod(F.xxhash64("doc"), "parts").cast("int")).drop("n", "parts")
    told = lambda hubs: hubs.join(parts, "hub").select(*hubs.columns, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("deal"))
    asked = small(members.select("doc").union(members.select("hub")).distinct())
    own = checkpointed(sets.join(asked, "doc", "left_semi").select("doc", "data"))
    centres = own.select(F.col("doc").alias("hub"), F.col("data").alias("h")).join(members.select("hub").distinct(), "hub", "left_semi").dropDuplicates(["hub"])
    both = members.join(own.withColumnRenamed("data", "x"), "doc").join(told(centres), ["hub", "deal"]).withColumn("own", F.xxhash64("x"))  # ids may repeat
    found = checkpointed(both.select("hub", "deal", "doc", "own", "c", "x", "h").mapInArrow(_differences, "hub long, deal int, doc long, own long, c long, n int, tokens array<long>"))
    # what most members have in common is moved into the centre, so that what is left is their own
    count = small(found.groupBy("hub").agg(F.count(F.lit(1)).alias("members"), F.greatest(F.lit(1), F.ceil(F.sum(F.size("tokens")) / SLICE)).cast("int").alias("slices")))
    found = found.join(count.select("hub", "slices"), "hub")
    # a part asks about its tokens in packed messages, as a row for each would be one for each difference
    asked = lambda found: found.select("hub", "deal", "slices", "c", "far", "tokens").mapInArrow(_asked, "hub long, deal int, slice int, data binary")
    voted = asked(found.withColumn("far", F.lit(False))).join(count.select("hub", "members"), "hub")
    voted = voted.groupBy("hub", "slice").applyInArrow(_moved, "hub long, moved array<long>")
    moved = voted.groupBy("hub").agg(F.flatten(F.collect_list("moved")).alias("moved"))  # at most two sets' tokens
    found = found.join(told(moved), ["hub", "deal"], "left").withColumn("moved", F.coalesce("moved", F.array().cast("array<long>")))
    found = found.withColumn("tokens", F.array_union(F.array_except("tokens", "moved"), F.array_except("moved", "tokens"))).drop("moved")
    found = checkpointed(found.withColumn("excess", F.size("tokens") * F.lit(part + whole).cast("long") - F.col("n") * (whole - part)))
    least = found.groupBy("hub").agg(F.min(F.struct("excess", "doc")).alias("least"))
    found = found.join(told(least.select("hub", F.col("least.excess").alias("low"), F.col("least.doc").alias("nearest"))), ["hub", "deal"])
    found = found.withColumn("far", F.col("excess") + F.col("low") > 0)
    links = found.where("not far and doc <> nearest").select(F.col("doc").alias("a"), F.col("nearest").alias("b"))
    # far ones meet far ones in groups of one kind, and near ones in groups of the other
    lows = found.where("size(tokens) > 0").groupBy("hub").agg(F.min(F.when(F.col("far"), F.col("excess"))).alias("low_far"), F.min(F.when(~F.col("far"), F.col("excess"))).alias("low_near")).where("low_far is not null")
    found = found.join(told(lows), ["hub", "deal"]).withColumn("d", F.size("tokens"))
    need = lambda low: F.greatest(F.lit(1), F.ceil((F.col("excess") + low) / step))
    found = found.withColumn("with_far", need(F.col("low_far"))).withColumn("with_near", F.when(F.col("far"), need(F.col("low_near"))))
    found = found.where(F.least("with_far", "with_near") <= F.col("d"))
    found = checkpointed(found)
    often = asked(found).groupBy("hub", "slice").applyInArrow(_often, "hub long, deal int, data binary")
    new = found.groupBy("hub", "deal").cogroup(often.groupBy("hub", "deal")).applyInArrow(_placed, "hub long, token long, doc long, n int, excess long, room int, far boolean, kind int")
    return links, new.withColumn("g", F.xxhash64("hub", "token", "kind")).select(ENTRY)


def jaccard_groups(docs: DataFrame, shingle: int = SHINGLE, part: int = PART, whole: int = WHOLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: the least id that links lead to."""
    ensure_checkpoint_dir(docs.sparkSession)
    n = bucket_count(docs, text, BUCKET_BYTES)
    parts = part_count(n)
    groups = bucketed(docs, n, doc_id, text).groupBy("bucket")
    first = groups.applyInArrow(_first(parts, shingle, part, whole), _MESSAGE)
    shared = first.groupBy("part").applyInArrow(an.shared_anchors(1 << 30), "bucket int, data binary")
    second = checkpointed(groups.cogroup(shared.groupBy("bucket")).applyInArrow(_second(parts, shingle, part, whole), SECOND))
    sent = second.where("kind = 2").select(F.col("n").alias("part"), "bucket", "data")
    told = sent.groupBy("part").applyInArrow(_frequencies, "bucket int, data binary")
    remaining = second.where("kind = 1").select("bucket", "doc", "data")
    third = checkpointed(remaining.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(_third(parts, part, whole), THIRD))

    rows = second.where("kind = 0").select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "print")
    return grouped_rows(rows, remaining, third, part, whole, _decide(part, whole))


def grouped_rows(rows: DataFrame, remaining: DataFrame, third: DataFrame, part: int, whole: int, decide) -> DataFrame:
    """rows: doc_id, n_shingles, print (null without candidates); remaining: doc, data of the sets;
    third: as THIRD says; decide: those of pairs a, b with sets x, y that are alike. Gives rows
    their component_id."""
    copies = rows.where("print is not null")
    least = copies.groupBy("print").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("most")).where("b < most")
    copies = copies.join(small(least), "print").select(F.col("doc_id").alias("a"), "b")

    def alike(pairs: DataFrame) -> DataFrame:
        pairs = checkpointed(pairs)
        asked = small(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct())
        sets = remaining.join(asked, "doc", "left_semi")
        with_x = pairs.join(sets.select(F.col("doc").alias("a"), F.col("data").alias("x")), "a")
        both = with_x.join(sets.select(F.col("doc").alias("b"), F.col("data").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(decide, "a long, b long")

    chained = third.where("kind = 4").select("n", "data").groupBy("n").applyInArrow(_chain(part, whole), "a long, b long").distinct()
    links = third.where("kind = 2").select("a", "b").union(copies).union(alike(chained))
    inner = components(links)

    entries = third.where("kind = 3").select("data").mapInArrow(_entries(part, whole), "g long, doc long, n int, excess long, room int, far boolean, kind int")
    entries = _between(entries, inner)
    for turn in range(TURNS):
        most = FEW_DIVIDED if turn else FEW
        few = entries.where(F.col("others") <= most)
        links = alike(_pairs(few, part, whole))
        crowd = entries.where(F.col("others") > most)
        done = crowd.isEmpty()
        if not turn:  # crowded groups around one component are one group, so that a document is in it once
            crowd = crowd.select(F.col("top").alias("g"), "doc", "n", "c").distinct()
        if not done:
            direct, entries = _recentred(crowd, remaining, turn, part, whole)
            links = links.union(direct)
        inner = components(inner.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))
        if done:
            break
        entries = _between(entries, inner)
    else:
        inner = components(inner.select(F.col("node").alias("a"), F.col("component").alias("b")).union(alike(_pairs(entries, part, whole))))
    return rows.join(small(inner).withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))

"""Best-fit packing of token sequences with a swap-based local search.

Documents become token ids and pieces of at most `capacity` ids in one narrow pass. Slim rows (ids and
lengths, no tokens) are dealt at random into groups of bounded size; each group is packed by best fit in
falling order of length and then improved: the emptiest sequences give documents away by moves, one-for-one
and two-for-one exchanges, each of which raises the sum of squared fills, until sequences empty.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.texts import by_text
from flowlens.plans.shared import cut

CAPACITY, END_ID = 1024, 2
#: Pieces that are packed together; more change the fill by less than one sequence in so many.
GROUP = 8192
#: How a byte-level BPE with this vocabulary cuts text into words before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Token ids, as little-endian 32-bit bytes, of the byte-level BPE in a tokenizers file.

    The file's vocabulary is handed to tiktoken, which merges by the same ranks several times as fast; a file
    for which that does not hold (checked on samples when it is loaded) is used through tokenizers itself, and
    so is a text that tiktoken refuses, as its regex does with a run of some hundred thousand blanks.
    """

    SAMPLES = ("The quick, brown fox's 12 jumps!\n\n  over", "Straße\u00a0über 中文 \U0001f600\t x", "a<|endoftext|>b  ", "'tis we'll\r\n$3.50", "")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = self._fast()

    def _fast(self):
        import tiktoken

        own = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
        byte = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*kept}))}
        try:
            ranks = {bytes(byte[c] for c in k): i for k, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if k not in own}
            made = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=own)
            same = all(made.encode(t, allowed_special="all") == self.tokenizer.encode(t, add_special_tokens=False).ids for t in self.SAMPLES)
        except (KeyError, ValueError):
            return None
        return made if same else None

    def encode(self, text: str) -> bytes:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
            except ValueError:
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row.

    A document's ids are those of the tokenizer at `path` and `end_id`; null counts as empty. A document
    longer than capacity is cut from its end into full pieces, and the first piece takes what is left.
    """
    def of(texts: list) -> tuple[dict[str, pa.Array], list[int]]:
        encode, last = encoder(path).encode, np.array([end_id], "<u4").tobytes()
        counts, rows, parts = [], [], []
        for t in texts:
            ids = encode(t or "") + last
            n = len(ids) // 4
            cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
            counts.append(len(cuts) - 1)
            for i, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                part = ids[4 * s : 4 * e]
                rows.append((i, s, e - s, zlib.crc32(part)))
                if keep_ids:
                    parts.append(np.frombuffer(part, "<u4"))
        table = np.array(rows, np.int64).reshape(-1, 4)
        made = {"piece": pa.array(table[:, 0].astype(np.int32)), **{c: pa.array(table[:, k + 1]) for k, c in enumerate(("start", "length", "ids_crc32"))}}
        if keep_ids:
            made["ids"] = pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64()))
        return made, counts

    return by_text(docs, of, "piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if keep_ids else ""), doc_id, text)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin of each length: in falling order, into the fullest bin with room, found by a bit mask over free sizes."""
    bins = np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, made = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            room, b, made = capacity, made, made + 1
        bins[i] = b
        if room > n:
            free[room - n].append(b)
            mask |= 1 << (room - n)
    return bins


def improve(lengths: np.ndarray, bins: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Local search on a packing until no step is left; every step raises the sum of squared fills, so it ends.

    The emptiest bin gives, while it can: a document to a bin with room; a document for a smaller one of
    another bin (one-for-one); two documents for one that is smaller than both together (two-for-one).
    """
    bins = bins.copy()
    n = int(bins.max()) + 1 if len(bins) else 0
    fill = np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)
    held: list[list[int]] = [[] for _ in range(n)]
    for i, b in enumerate(bins.tolist()):
        held[b].append(i)
    least = -(-int(fill.sum()) // capacity)
    moved = True
    while moved:
        moved = False
        for v in np.argsort(fill, kind="stable").tolist():
            if np.count_nonzero(fill) <= least:
                return bins
            if fill[v] in (0, capacity):
                continue
            while held[v]:
                step = _step(lengths, held[v], bins, fill, v, capacity)
                if step is None:
                    break
                gone, target, back = step
                gain = int(lengths[gone].sum()) - (int(lengths[back]) if back is not None else 0)
                for i in gone:
                    held[v].remove(i)
                    held[target].append(i)
                    bins[i] = target
                if back is not None:
                    held[target].remove(back)
                    held[v].append(back)
                    bins[back] = v
                fill[target] += gain
                fill[v] -= gain
                moved = True
    return bins


def _best(sums: np.ndarray, size: np.ndarray, fills: np.ndarray, fill: int, capacity: int) -> tuple[int, int] | None:
    """(place of a sum, place of a partner): of ascending sums that leave a bin for partners of these sizes, the step of
    the largest gain of the partner's bin. A step must fit and leave that bin fuller than this bin was."""
    at = np.searchsorted(sums, size + (capacity - fills), side="right") - 1  # the largest sum that fits each partner
    gain = sums[at] - size
    gain = np.where((at >= 0) & (gain > 0) & (fills + gain > fill), gain, 0)
    k = int(gain.argmax())
    return (int(at[k]), k) if gain[k] else None


def _step(lengths: np.ndarray, own: list[int], bins: np.ndarray, fill: np.ndarray, v: int, capacity: int) -> tuple[list[int], int, int | None] | None:
    """The next step of bin v: (documents that leave, bin they go to, document that comes back)."""
    mine = np.array(own)
    size, first = np.unique(lengths[mine], return_index=True)
    room = np.flatnonzero((fill > 0) & (fill < capacity) & (np.arange(len(fill)) != v))
    if not len(room):
        return None
    now = int(fill[v])
    if (hit := _best(size, np.zeros(len(room), np.int64), fill[room], now, capacity)) is not None:
        return [int(mine[first[hit[0]]])], int(room[hit[1]]), None
    partner = np.flatnonzero((fill[bins] < capacity) & (bins != v))
    theirs, fills = lengths[partner], fill[bins[partner]]
    if (hit := _best(size, theirs, fills, now, capacity)) is not None:
        other = int(partner[hit[1]])
        return [int(mine[first[hit[0]]])], int(bins[other]), other
    if len(mine) < 2:
        return None
    order = mine[np.argsort(lengths[mine], kind="stable")]
    twice = {}  # a pair for each sum; equal documents add none but their own double
    kept = [i for k, i in enumerate(order.tolist()) if k < 2 or lengths[i] != lengths[order[k - 2]]]
    for k, i in enumerate(kept):
        for j in kept[k + 1 :]:
            twice.setdefault(int(lengths[i] + lengths[j]), (i, j))
    pairs = np.array(sorted(twice))
    if (hit := _best(pairs, theirs, fills, now, capacity)) is not None:
        other = int(partner[hit[1]])
        return [*twice[int(pairs[hit[0]])]], int(bins[other]), other
    return None


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """pieces (with columns uid long and length long, written) with sequence_id and offset.

    Groups are hashes of uid, so they are even whatever repeats; their number follows from a count.
    Sequences are numbered within a group, and group numbers make them unique.
    """
    groups = max(1, round(pieces.count() / group))
    kinds = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)

    def of(table: pa.Table) -> pa.Table:
        table = table.sort_by("uid")
        lengths, g = table.column("length").to_numpy(), table.column("g").to_numpy()
        table = table.drop_columns(["g"])
        bins = improve(lengths, best_fit(lengths, capacity), capacity)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
        offset = np.empty(len(lengths), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        return table.append_column("sequence_id", pa.array(g * (1 << 24) + bins)).append_column("offset", pa.array(offset))

    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("uid"), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(of, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): each piece's place in a sequence.

    Repeated rows are packed one by one; null text is a lone end_id; an empty table gives no rows; other
    columns of docs are not read. Token ids stay out of the shuffle: token_pieces(keep_ids=True) makes them
    again for whoever writes the sequences.
    """
    pieces = token_pieces(docs, path, capacity, end_id).withColumn("uid", F.monotonically_increasing_id())
    return pack_pieces(cut(pieces, "pieces"), capacity, group).drop("uid")

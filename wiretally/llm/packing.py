"""Order-preserving packing of token streams into sequences.

Documents follow each other by id. A dynamic programme over the boundaries of documents and
sentences chooses where sequences end, minimising padding plus penalties for truncation. The
best predecessor of a cut is the smallest value of a sliding range, kept in a monotone queue,
so the work is linear in the number of boundaries.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import map_rows, texts_of

WINDOW = 1024
#: Penalties, in tokens of padding: a cut between sentences, a cut inside one, a sequence at all.
SENTENCE_CUT = 4
INNER_CUT = 32
PER_SEQUENCE = 8
#: Sentences longer than this also get inner boundaries, this far apart.
LONGEST_STEP = 64
#: Shortest sequence that is left at a power of two instead of being padded.
LEAST_POWER = 1
#: Tokens over which one run of the programme goes; its last sequence starts the next run.
RUN_TOKENS = 1 << 18
#: Chunks whose ids are remembered by a task.
MEMO = 1_000_000
END_ID = 0

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long"
)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One per worker process: later tasks find it warm."""
    return Encoder(path)


class Encoder:
    """Ids of whole texts as little-endian bytes, remembering the ids of space-led chunks.

    The vocabulary's word pattern always starts a new word at a single space, so a text is the
    concatenation of its chunks, except where a space stands next to other white space or a
    special token occurs; those texts are encoded whole.
    """

    def __init__(self, path: str, memo: int = MEMO):
        import tiktoken
        from tokenizers import Tokenizer

        import public_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        letters = _byte_letters()
        self.vocab = {
            bytes(letters[c] for c in word): i for word, i in self.whole.get_vocab().items() if word not in self.specials
        }
        self.chunks = tiktoken.Encoding(
            "chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.vocab, special_tokens={}
        )
        self.odd = re.compile(" \\s|\\s $|^ ")
        self.memo, self.limit = {}, memo
        self.sentence_marks = self._sentence_marks()

    def bytes_of(self, text: str) -> bytes:
        if self.odd.search(text) or any(s in text for s in self.specials):
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        head, *rest = text.split(" ")
        memo = self.memo
        try:
            return self._chunk(head) + b"".join([memo[w] for w in rest])
        except KeyError:
            if len(memo) > self.limit:
                memo.clear()
            return self._chunk(head) + b"".join([memo[w] if w in memo else self._learn(w) for w in rest])

    def _chunk(self, chunk: str) -> bytes:
        return np.asarray(self.chunks.encode_ordinary(chunk), "<u4").tobytes()

    def _learn(self, word: str) -> bytes:
        found = self.memo[word] = self._chunk(" " + word)
        return found

    def _sentence_marks(self) -> tuple[np.ndarray, np.ndarray]:
        """By id: whether it ends a sentence, and whether it can start the next one."""
        size = max(self.vocab.values(), default=0) + len(self.specials) + 1
        ends, starts = np.zeros(size, bool), np.zeros(size, bool)
        for word, i in self.vocab.items():
            ends[i] = word[-1:] in (b".", b"!", b"?", b"\n")
            starts[i] = word[:1] in (b" ", b"\n")
        return ends, starts


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def choose_cuts(at: list[int], penalty: list[float], window: int = WINDOW, least_power: int = LEAST_POWER) -> list[int]:
    """Indices into ``at`` where sequences end, at the least total cost.

    ``at``: rising token positions from 0 to the end, at most ``window`` apart; ``penalty``:
    the cost of a cut there. A sequence costs its padding up to ``window`` (none at a power of
    two from ``least_power`` on) plus ``PER_SEQUENCE``.
    """
    n = len(at)
    where = np.asarray(at)
    pairs = []
    power = least_power
    while power < window:
        i = np.searchsorted(where, where - power)
        j = np.nonzero(where[np.minimum(i, n - 1)] == where - power)[0]
        pairs.append(np.stack([j, i[j]], 1))
        power *= 2
    exact = np.concatenate(pairs) if pairs else np.zeros((0, 2), int)
    exact = exact[np.argsort(exact[:, 0], kind="stable")].tolist()
    exact.append([n, 0])
    best, came = [0.0] * n, [0] * n
    queue, head, key, low, nth = [0], 0, [0.0] * n, 0, 0
    for j in range(1, n):
        p = at[j]
        low = p - window
        while at[queue[head]] < low:
            head += 1
        i = queue[head]
        cost = key[i] + window - p
        while exact[nth][0] == j:
            other = exact[nth][1]
            if best[other] < cost:
                cost, i = best[other], other
            nth += 1
        cost += penalty[j] + PER_SEQUENCE
        best[j], came[j] = cost, i
        k = key[j] = cost + p
        while len(queue) > head and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = came[j]
    return cuts[::-1]


def boundaries(
    ids: np.ndarray, ends: list[int], marks: tuple[np.ndarray, np.ndarray], dense_from: int | None = None
) -> tuple[list[int], list[float]]:
    """Candidate positions and their penalties; ``ends``: where documents end in ``ids``.

    From ``dense_from`` on, every position is a candidate: the end of a stream can then be
    split into powers of two instead of being padded.
    """
    total = len(ids)
    cost = np.full(total + 1, np.inf)
    is_end, is_start = marks
    stops = np.nonzero(is_end[ids[:-1]] & is_start[ids[1:]])[0] + 1
    cost[stops] = SENTENCE_CUT
    cost[ends] = 0
    cost[0] = 0
    known = np.nonzero(cost < np.inf)[0]
    gaps = np.diff(known)
    for g in np.nonzero(gaps > LONGEST_STEP)[0]:
        cost[known[g] + LONGEST_STEP : known[g + 1] : LONGEST_STEP] = INNER_CUT
    if dense_from is not None:
        cost[dense_from:] = np.minimum(cost[dense_from:], INNER_CUT)
    known = np.nonzero(cost < np.inf)[0]
    return known.tolist(), cost[known].tolist()


def _pack(encode: Encoder, window: int, run_tokens: int):
    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        marks = encode.sentence_marks
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 40
        open_docs: list[tuple] = []  # (doc_id, tokens of the document, start here, bytes)
        held = 0

        def run(last: bool) -> dict:
            nonlocal open_docs, held, sequence
            data = b"".join(d[3] for d in open_docs)
            ends = list(accumulate(len(d[3]) // 4 for d in open_docs))
            at, penalty = boundaries(
                np.frombuffer(data, "<u4"), ends, marks, max(0, ends[-1] - 2 * window) if last else None
            )
            cuts = [at[j] for j in choose_cuts(at, penalty, window)]
            out = {c.split()[0]: [] for c in PIECES.split(", ")}
            keep, begin, d = [], 0, 0
            for n, cut in enumerate(cuts):
                whole, offset, at_token = last or n + 1 < len(cuts), 0, begin
                while at_token < cut:
                    doc, tokens, first, body = open_docs[d]
                    base = ends[d] - len(body) // 4
                    stop = min(ends[d], cut)
                    if whole:
                        values = (doc, first + at_token - base, stop - at_token, zlib.crc32(data[4 * at_token : 4 * stop]))
                        for column, value in zip(out.values(), (*values, tokens, sequence, offset, cut - begin)):
                            column.append(value)
                    else:
                        keep.append((doc, tokens, first + at_token - base, data[4 * at_token : 4 * stop]))
                    offset += stop - at_token
                    at_token = stop
                    d += stop == ends[d]
                begin = cut
                sequence += whole
            open_docs, held = keep, sum(len(k[3]) for k in keep) // 4
            return out

        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"]):
                body = encode.bytes_of(text) + end
                open_docs.append((doc, len(body) // 4, 0, body))
                held += len(body) // 4
                if held >= run_tokens:
                    yield run(False)
        if open_docs:
            yield run(True)

    return rows


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, run_tokens: int = RUN_TOKENS) -> DataFrame:
    """Pack whole ``docs`` into sequences of at most ``window`` tokens; one row per piece.

    A document is its token ids and then id 0; a null or empty text is that id alone. Documents
    are taken by id (null first; rows of one id by text), split into ranges that tasks pack one
    by one, and each range is a stream: memory holds one run of tokens, or one document.
    Repeated rows are documents of their own; an empty table gives no piece. ``length`` ids
    from ``start`` on stand at ``offset`` of ``sequence_id``.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")

    def rows(batches):
        yield from _pack(encoder(tokenizer), window, run_tokens)(batches)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = texts_of(docs).repartitionByRange(parts, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return map_rows(ordered, rows, PIECES)

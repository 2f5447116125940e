"""Phrase collocations by HAT-trie counting.

Phrases are counted one length after the other. A task walks its texts once a length
and counts in a :class:`HatTrie`: a shallow trie by the language and the digits of the
first word's id, over hash containers of paths, which burst into branches as they fill.
When the trie is full, its largest subtrees are written out whole as sorted runs of
(language, phrase, count); the runs of all tasks are then merged by ranges of their
prefixes. Nothing of a task's memory grows with the corpus.

A phrase can be frequent only if both phrases one word shorter inside it are. Those
of the length before are therefore sent to the tasks as a bitmap of fixed size, whose
false hits cost time and never change a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from originline.llm.common import mix, prepare, text_bytes
from originline.llm.ngram_join import Bits, bitmap
from originline.session import stage

LONGEST, LEAST, TOP = 5, 100, 2000
#: Bytes that end a piece, and those that separate words inside one.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"

_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_APART = _BREAK.copy()
_APART[list(BLANKS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x100000001B3)


class Words:
    """Words of a stretch of texts: bytes, hashes, pieces, and the text each lies in.

    The first ``carried`` of them belong to the stretch before.
    """

    def __init__(self, data: np.ndarray, starts, ends, hashes, pieces, owners, carried: int = 0) -> None:
        self.data, self.starts, self.ends, self.hashes = data, starts, ends, hashes
        self.pieces, self.owners, self.carried = pieces, owners, carried

    def __len__(self) -> int:
        return len(self.starts)

    def after(self, other: Words | None, keep: int) -> Words:
        """These words behind the last ``keep`` of ``other``."""
        if other is None or keep == 0 or len(other) == 0:
            return self
        names = ("starts", "ends", "hashes", "pieces", "owners")
        both = [np.concatenate([getattr(other, n)[-keep:], getattr(self, n)]) for n in names]
        return Words(self.data, *both, carried=min(keep, len(other)))


def word_stretches(data: np.ndarray, offsets: np.ndarray, keep: int, chunk: int = 1 << 20) -> Iterator[Words]:
    """All words of a batch of lower-cased texts, in stretches of about ``chunk`` bytes.

    A stretch ends between words, inside a text or not; it carries the last ``keep``
    words of the one before, so a phrase across the border is seen once.
    """
    low, n, pieces, before = 0, len(data), 0, None
    while low < n:
        high = min(low + chunk, n)
        while high < n:
            apart = np.flatnonzero(_APART[data[high : high + 65536]])
            if len(apart):
                high += int(apart[0])
                break
            high = min(high + 65536, n)
        part = data[low:high]
        inner = offsets[(offsets > low) & (offsets < high)] - low
        apart = _APART[part]
        first, last = ~apart, ~apart
        first[1:] &= apart[:-1]
        last[:-1] &= apart[1:]
        first[inner] = ~apart[inner]
        last[inner - 1] = ~apart[inner - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(starts):
            own = Words(data, starts + low, ends + low, _hashed(part, apart, starts), None, None)
            own.owners = np.searchsorted(offsets, own.starts, side="right") - 1
            own.pieces = np.cumsum(_BREAK[part])[starts] + own.owners + pieces
            own = own.after(before, keep)
            yield own
            before = own
        pieces += int(np.count_nonzero(_BREAK[part]))
        low = high


def _hashed(part: np.ndarray, apart: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A sum over the bytes of a word, each scrambled with its place in the word."""
    begin = np.zeros(len(part), np.int64)
    begin[starts] = starts
    place = np.arange(len(part), dtype=np.int64) - np.maximum.accumulate(begin)
    with np.errstate(over="ignore"):
        value = mix((place.astype(np.uint64) << np.uint64(8)) + part + np.uint64(1))
        value[apart] = 0
        return mix(np.add.reduceat(value, starts) + np.uint64(0x9E3779B97F4A7C15))


def _salt(lang: str) -> int:
    data = np.frombuffer(lang.encode("utf-8", "surrogatepass"), np.uint8)
    with np.errstate(over="ignore"):
        at = np.arange(len(data), dtype=np.uint64) << np.uint64(8)
        return int(mix((mix(at + data + np.uint64(7)).sum(dtype=np.uint64) + np.uint64(len(data)))[None])[0])


def _phrase_hashes(words: np.ndarray, salts: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from every place on."""
    n = max(len(words) - length + 1, 0)
    with np.errstate(over="ignore"):
        value = salts[:n].copy()
        for k in range(length):
            value = mix(value * _STEP + words[k : k + n])
    return value


class Box:
    """A hash container: keys, counts and paths in open addressing, filled a batch at a time."""

    def __init__(self, length: int, slots: int = 1024) -> None:
        self.size, self.length = 0, length
        self._make(slots)

    def _make(self, slots: int) -> None:
        self.keys, self.counts = np.zeros(slots, np.uint64), np.zeros(slots, np.int64)
        self.paths = np.zeros((slots, self.length), np.int32)

    def add(self, keys: np.ndarray, counts: np.ndarray, paths: np.ndarray) -> None:
        """Count distinct, non-zero keys."""
        need = 2 * (self.size + len(keys))
        if need > len(self.keys):
            old = self.content()
            self.size = 0
            self._make(1 << int(need - 1).bit_length())
            self._put(*old)
        self._put(keys, counts, paths)

    def _put(self, keys: np.ndarray, counts: np.ndarray, paths: np.ndarray) -> None:
        last = np.uint64(len(self.keys) - 1)
        slot = ((keys ^ (keys >> np.uint64(32))) & last).astype(np.int64)
        open_rows = np.arange(len(keys))
        while len(open_rows):
            there, own = self.keys[slot], keys[open_rows]
            free = np.flatnonzero(there == 0)
            if len(free):  # of several rows that want a slot the last one has it
                self.keys[slot[free]] = own[free]
                won = free[self.keys[slot[free]] == own[free]]
                self.paths[slot[won]] = paths[open_rows[won]]
                self.size += len(won)
            hit = self.keys[slot] == own
            self.counts[slot[hit]] += counts[open_rows[hit]]
            open_rows, slot = open_rows[~hit], (slot[~hit] + 1) & int(last)

    def content(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        used = self.keys != 0
        return self.keys[used], self.counts[used], self.paths[used]


class HatTrie:
    """Counts of paths (language, word, word, ...) of local ids.

    The trie branches by the language and then by the digits of the first word's id,
    ``DIGIT`` bits each. Below lie hash containers (:class:`Box`) of whole paths; one
    that holds more than ``burst`` of them bursts into a branch, down to ``DEEPEST``.
    """

    DIGIT, DEEPEST = 4, 4

    def __init__(self, length: int, burst: int = 1 << 15) -> None:
        self.length, self.burst = length, burst
        self.root = Branch()

    def _digit(self, paths: np.ndarray, depth: int) -> np.ndarray:
        if depth == 0:
            return paths[:, 0]
        return (paths[:, 1] >> (self.DIGIT * (depth - 1))) & ((1 << self.DIGIT) - 1)

    def add(self, keys: np.ndarray, counts: np.ndarray, paths: np.ndarray) -> None:
        """Count distinct paths, each with a 64-bit key that no other path has."""
        self._spread(self.root, 0, np.maximum(keys, np.uint64(1)), counts, paths)

    def _spread(self, node: Branch, depth: int, keys: np.ndarray, counts: np.ndarray, paths: np.ndarray) -> None:
        if len(keys) == 0:
            return
        digit = self._digit(paths, depth)
        order = np.argsort(digit, kind="stable")
        digit, keys, counts, paths = digit[order], keys[order], counts[order], paths[order]
        edges = [0, *(np.flatnonzero(digit[1:] != digit[:-1]) + 1).tolist(), len(digit)]
        for low, high in zip(edges, edges[1:], strict=False):
            key = int(digit[low])
            child = node.children.get(key)
            if child is None:
                child = node.children[key] = Box(self.length + 1)
            if isinstance(child, Branch):
                self._spread(child, depth + 1, keys[low:high], counts[low:high], paths[low:high])
                continue
            child.add(keys[low:high], counts[low:high], paths[low:high])
            if child.size > self.burst and depth + 1 < self.DEEPEST:
                node.children[key] = Branch()
                self._spread(node.children[key], depth + 1, *child.content())

    def subtrees(self) -> list[tuple[Box, Branch, int, tuple[int, ...]]]:
        """Every container, the branch above it, its key there, and the path of digits."""
        found, open_nodes = [], [((), self.root)]
        while open_nodes:
            path, node = open_nodes.pop()
            for key, child in node.children.items():
                if isinstance(child, Branch):
                    open_nodes.append(((*path, key), child))
                else:
                    found.append((child, node, key, (*path, key)))
        return found

    @property
    def size(self) -> int:
        return sum(box.size for box, *_ in self.subtrees())

    def spill(self, room: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Take whole subtrees out, the largest first, until ``room`` paths are left."""
        left = self.size
        for box, node, key, _ in sorted(self.subtrees(), key=lambda s: (-s[0].size, s[3])):
            if left <= room:
                break
            del node.children[key]
            left -= box.size
            _, counts, paths = box.content()
            yield paths, counts


class Branch:
    __slots__ = ("children",)

    def __init__(self) -> None:
        self.children: dict[int, Box | Branch] = {}


class _Local:
    """Ids of the words and languages a task has in its trie."""

    def __init__(self) -> None:
        self.words: list[bytes] = []
        self.of_hash: dict[int, int] = {}
        self.langs: dict[str, int] = {}
        self.salts: list[int] = []

    def lang(self, name: str) -> int:
        at = self.langs.get(name)
        if at is None:
            at = self.langs[name] = len(self.langs)
            self.salts.append(_salt(name))
        return at

    def ids(self, hashes: np.ndarray, at: np.ndarray, words: Words) -> np.ndarray:
        out, data = np.empty(len(hashes), np.int32), words.data
        starts, ends = words.starts[at].tolist(), words.ends[at].tolist()
        for k, value in enumerate(hashes.tolist()):
            known = self.of_hash.get(value)
            if known is None:
                known = self.of_hash[value] = len(self.words)
                self.words.append(data[starts[k] : ends[k]].tobytes())
            out[k] = known
        return out


def _paths(words: Words, langs: np.ndarray, local: _Local, length: int, known: Bits | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct phrases of a stretch that may be frequent: hashes, counts, and paths of local ids."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, length + 1), np.int32)
    own = langs[words.owners]
    salts = np.array(local.salts, np.uint64)[own]
    there = words.pieces[:n] == words.pieces[length - 1 :]
    there[: max(words.carried - length + 1, 0)] = False
    if known is not None:
        shorter = known.has(_phrase_hashes(words.hashes, salts, length - 1))
        there &= shorter[:n] & shorter[1 : n + 1]
    at = np.flatnonzero(there)
    value = _phrase_hashes(words.hashes, salts, length)[at]
    value, first, counts = np.unique(value, return_index=True, return_counts=True)
    places = at[first][:, None] + np.arange(length)
    flat = places.ravel()
    hashes, one, back = np.unique(words.hashes[flat], return_index=True, return_inverse=True)
    ids = local.ids(hashes, flat[one], words)
    return value, counts, np.column_stack([own[at[first]].astype(np.int32), ids[back].reshape(places.shape)]).astype(np.int32)


def _runs(subtrees: Iterator[tuple[np.ndarray, np.ndarray]], local: _Local, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Every subtree as a run of (lang, phrase, n) sorted by its phrases."""
    words = pa.array(local.words, pa.binary())
    langs = pa.array(list(local.langs), pa.string())
    held, size = [], 0
    for paths, counts in subtrees:
        columns = [words.take(pa.array(paths[:, k])) for k in range(1, paths.shape[1])]
        phrase = pc.binary_join_element_wise(*columns, b" ") if len(columns) > 1 else columns[0]
        order = pc.sort_indices(phrase)
        lang = pa.DictionaryArray.from_arrays(pa.array(paths[:, 0]), langs).dictionary_decode()
        held.append([lang, phrase.take(order).cast(pa.string()), pa.array(counts).take(order)])
        size += len(counts)
        if size >= rows:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[list[pa.Array]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays(list(c)) for c in zip(*held, strict=True)], ["lang", "phrase", "n"])


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def counted(docs: DataFrame, length: int, shorter: Bits | None, room: int = 1_500_000) -> DataFrame:
    """``lang``, ``phrase`` and its count ``n``, of all phrases of ``length`` words that may be frequent.

    ``shorter`` holds the frequent phrases one word shorter; ``room`` is how many
    phrases a task keeps. The runs are written to the shared folder and merged there.
    """
    shared = None if shorter is None else docs.sparkSession.sparkContext.broadcast(shorter)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if shared is None else shared.value
        trie, local = HatTrie(length), _Local()
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            langs = np.array([local.lang(x) for x in batch.column(0).to_pylist()], np.int32)
            for words in word_stretches(_LOWER[data], offsets, length - 1):
                trie.add(*_paths(words, langs, local, length, known))
                if trie.size > room:
                    yield from _runs(trie.spill(room // 2), local)
                if len(local.words) > room:
                    yield from _runs(trie.spill(0), local)
                    local.words, local.of_hash = [], {}
        yield from _runs(trie.spill(0), local)

    runs = stage(_texts(docs).mapInArrow(work, "lang string, phrase string, n long"), "runs")
    ranged = runs.repartitionByRange(F.col("lang"), F.col("phrase"))
    return ranged.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _known(phrases: DataFrame, length: int) -> Bits:
    """The bitmap of frequent phrases of one length, hashed as in the tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts: dict[str, int] = {}
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            langs = batch.column(0).to_pylist()
            salts |= {x: _salt(x) for x in set(langs) - salts.keys()}
            own = np.array([salts[x] for x in langs], np.uint64)
            found = []
            for words in word_stretches(data, offsets, length - 1):
                value = _phrase_hashes(words.hashes, own[words.owners], length)
                n = len(value)
                same = words.owners[:n] == words.owners[length - 1 :] if n else np.zeros(0, bool)
                found.append(value[same])
            found = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["h"])

    return bitmap(stage(phrases.select("lang", "phrase").mapInArrow(work, "h long"), "hashes"), "h", each=256)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``longest`` words found ``least`` times (lang, phrase, words, f), and n per lang."""
    spark = prepare(docs.sparkSession)
    words = stage(counted(docs, 1, None), "words")
    totals = stage(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    often = [stage(words.where(F.col("n") >= least), "often")]
    while len(often) < longest and often[-1].limit(1).count():
        bits = _known(often[-1], len(often))
        often.append(stage(counted(docs, len(often) + 1, bits).where(F.col("n") >= least), "often"))
    found = spark.createDataFrame([], "lang string, phrase string, f long, words int")
    for k, level in enumerate(often):
        found = found.unionByName(level.select("lang", "phrase", F.col("n").alias("f"), F.lit(k + 1).alias("words")))
    return found, totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of every language by their weakest cut.

    A-Z are lower-cased; texts are split into pieces at ``. , ; : ! ?`` and line ends,
    pieces into words at blanks and tabs; phrases do not leave a piece. ``n`` is the
    number of all words of the language. Candidates are phrases of 2 to ``longest``
    words found ``a >= least`` times, overlaps included. Cut behind its first k words, a candidate has
    ``l`` and ``r``, the counts of both parts, and the score floor(1000 * a * n / (l * r));
    the least score counts, of equal ones that of the least k. A candidate inside a
    longer one found as often is left out. Ranks go by score and ``a``, both
    descending, then by the phrase's bytes.

    A null language is ``und``, a null text empty; an empty text or table has no
    phrase. Repeated rows and rows of one or no doc_id count as they stand; other
    columns are ignored. Texts are read whole. Words are told apart by 64-bit hashes inside a task.
    """
    found, totals = frequent_phrases(docs, least, longest)
    found = stage(found, "phrases")
    wide = found.where("words > 1")
    words = F.split("phrase", " ")
    part = lambda low, size: F.array_join(F.slice(words, low, size), " ")
    cuts = wide.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    one = lambda key, name: found.select("lang", F.col("phrase").alias(key), F.col("f").alias(name))
    told = cuts.join(one("left", "l"), ["lang", "left"]).join(one("right", "r"), ["lang", "right"]).join(totals, "lang")
    # 36 digits hold 1000 * a * n up to 10^15 of either; div is exact on decimals.
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    weakest = told.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # A longer candidate found as often holds one of one more word found as often.
    inner = wide.where("words > 2").select("lang", F.explode(F.array(
        part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words") - 1))).alias("phrase"), F.col("f").alias("a"))
    kept = weakest.join(inner, ["lang", "phrase", "a"], "left_anti")
    ranked = kept.select("lang", F.row_number().over(Window.partitionBy("lang").orderBy(
        F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase"))).cast("long").alias("rank"),
        "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    return ranked.where(F.col("rank") <= top)


#: Every count by brute force over all phrases of all texts.
ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
  FROM worded, range(1, 6) s(m) WHERE len(ws) >= m),
counts AS (SELECT lang, phrase, m, count(*) AS f FROM grams GROUP BY 1, 2, 3),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY 1),
candidates AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS ws FROM counts WHERE m > 1 AND f >= 100),
cuts AS (
  SELECT c.lang, c.phrase, a, m, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:m], ' ') AS rp
  FROM candidates c, range(1, 5) s(k) WHERE k < m),
scored AS (
  SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, n,
    ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = lp JOIN counts y ON y.lang = c.lang AND y.phrase = rp
  JOIN totals t ON t.lang = c.lang),
weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT DISTINCT lang, array_to_string(ws[i:i + s - 1], ' ') AS phrase, a AS f
  FROM candidates, range(2, 5) p(s), range(1, 5) q(i) WHERE s < m AND i + s - 1 <= m),
kept AS (
  SELECT * FROM weakest w WHERE NOT EXISTS (
    SELECT 1 FROM inside i WHERE i.lang = w.lang AND i.phrase = w.phrase AND 100 * i.f >= 100 * w.a))
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
WHERE rank <= 2000
"""

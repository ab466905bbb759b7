"""Operator 7, benchmark decontamination by canonical templates and consistent slots."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticklattice.llm._util import map_text

NUMBER, UNIT, NAME = 1, 2, 3
# Units of measure, and numbers in words.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers g kg mg lb lbs oz gram grams kilogram kilograms pound pounds"
    " ounce ounces ton tons l ml liter liters litre litres gallon gallons s sec ms min h hr second seconds minute minutes hour hours day days week weeks month months year years"
    " mph kph hz khz mhz ghz w kw mw v volt volts watt watts j kj cal kcal joule joules pa kpa bar k °c °f degree degrees percent % $ € £ usd eur dollar dollars euro euros cent cents"
    .split()
)
NUMERALS = frozenset("zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million billion dozen".split())
EDGE = ".,;:!?\"'()[]{}*#&|»«“”…"
#: Odd multiplier of the rolling window hash.
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Distinct words that a worker remembers at once.
REMEMBERED = 300_000
#: Bits of a word's code: its slot type, whether it is capitalised, whether a sentence ends with it, whether the items have
#: it uncapitalised; the rest is its number.
SLOT, CAPITAL, ENDS, COMMON, SHIFT = 3, 4, 8, 16, 5
#: Words from which an item has windows; a shorter one is only a document's whole text.
LEAST_WORDS = 4


def bare(word: str) -> str:
    return (word if word.isalpha() else word.strip(EDGE)).lower()


class Codes(dict):
    """word -> code, made as words come, with its number in the vocabulary of the templates (0: in none)."""

    def __init__(self, vocabulary: dict[str, int], common: frozenset[str]):
        super().__init__()
        self.vocabulary, self.common = vocabulary, common

    def __missing__(self, word: str) -> int:
        if word.isalpha():
            raw, ends = word, 0
        else:
            raw = word.strip(EDGE)
            ends = ENDS if word.rstrip("\"')]”»*#&|").endswith((".", "!", "?", ":")) else 0
        low = raw.lower()
        if low in NUMERALS or not raw.isalpha() and any(map(str.isdigit, raw)) and not any(map(str.isalpha, raw)):
            code = NUMBER
        elif low in UNITS and (len(low) > 1 or low in "%$€£"):
            code = UNIT
        else:
            code = capital(raw) * (CAPITAL | COMMON * (low in self.common))
        self[word] = code = code | ends | self.vocabulary.get(low, 0) << SHIFT
        return code

    def canonical(self, flat: list[str], starts: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """The words' numbers, and hashes and slot types of the words of texts that begin at `starts`: numbers, units and
        names are typed placeholders. A name is a capitalised word, wherever it stands, that the items never have
        uncapitalised; by a second reading, if it matters, also any other that does not begin a sentence or text."""
        if len(self) > REMEMBERED:
            self.clear()
        c = np.fromiter(map(self.__getitem__, flat), np.int64, len(flat))
        begins = np.zeros(len(c), bool)
        begins[1:] = (c[:-1] & ENDS) > 0
        begins[starts[starts < len(c)]] = True
        number, kind, name = c >> SHIFT, c & SLOT, (c & CAPITAL) > 0
        rare = name & ((c & COMMON) == 0)
        readings = []
        for names in (rare, rare | (name & ~begins)):
            if not readings or (names != rare).any():
                slot = np.where(names & (kind == 0), NAME, kind)
                readings.append((np.where(slot > 0, slot, number + SLOT + 1).astype(np.uint64), slot))
        return number.astype(np.uint64), readings


def capital(raw: str) -> bool:
    """Whether a word is capitalised, and not all in capitals."""
    return len(raw) > 1 and raw[0].isupper() and raw[1:].islower()


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Rolling hashes of all windows of n canonical words."""
    mixed = h * BASE
    mixed ^= mixed >> np.uint64(29)
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for j in range(n):
        out *= BASE
        out += mixed[j : j + len(out)]
    return out


#: item's place, window's place in it, the item's slot types (none: the words as they are)
Entry = tuple[int, int, np.ndarray | None]


class Templates:
    """The windows of a block of benchmark items, by hash: as templates, and word for word."""

    def __init__(self, items: Sequence[tuple[int, str]], window: int, literal: int):
        self.items: list[tuple[int, list[str]]] = []
        split = [(i, (t or "").split()) for i, t in items]
        self.vocabulary = {w: i for i, w in enumerate(sorted({bare(w) for _, ws in split for w in ws} - {""}), 1)}
        self.common = frozenset(x for _, ws in split for w in ws if (x := w.strip(EDGE)).islower())
        self.short: dict[tuple[str, ...], list[int]] = defaultdict(list)
        codes = Codes(self.vocabulary, self.common)
        found: dict[int, dict[int, list[Entry]]] = defaultdict(lambda: defaultdict(list))
        exact: dict[int, dict[int, list[Entry]]] = defaultdict(lambda: defaultdict(list))
        for item_id, words in split:
            n, at_item = min(window, len(words)), len(self.items)
            if words:
                self.items.append((item_id, [bare(w) for w in words]))
            if n < min(window, LEAST_WORDS):
                if words:
                    self.short[tuple(self.items[-1][1])].append(at_item)
                continue
            number, readings = codes.canonical(words, np.zeros(1, np.int64))
            for h, slot in readings:
                for at, x in enumerate(windows(h, n).tolist()):
                    if (slot[at : at + n] == 0).sum() >= min(literal, n - 1):
                        found[n][x].append((at_item, at, slot))
            for at, x in enumerate(windows(number, n).tolist()):
                exact[n][x].append((at_item, at, None))
        self.by_size, self.exact = self._index(found), self._index(exact)

    @staticmethod
    def _index(found: dict[int, dict[int, list[Entry]]]) -> dict[int, tuple[np.ndarray, np.ndarray, dict[int, list[Entry]]]]:
        out = {}
        for n, table in found.items():
            bits = np.zeros(1 << 20, bool)
            keys = np.array(sorted(table), np.uint64)
            bits[(keys >> np.uint64(44)).astype(np.int64)] = True
            out[n] = bits, keys, table
        return out

    def match(self, codes: Codes, texts: Sequence[str]) -> list[list[tuple[int, int, int, int, bool]]]:
        """For each text (item id, words covered, the item's words, slots whose value differs, reparameterised) of the items
        that it holds windows of, checked word by word, with one consistent value for each value of a slot."""
        split = [t.split() for t in texts]
        starts = np.cumsum([0, *map(len, split)])
        flat = [w for ws in split for w in ws]
        number, readings = codes.canonical(flat, starts[:-1])
        cover: dict[tuple[int, int], set[int]] = defaultdict(set)
        for d, ws in enumerate(split):
            if ws and len(ws) < LEAST_WORDS:
                for i in self.short.get(tuple(map(bare, ws)), ()):
                    cover[d, i].update(range(len(ws)))
        bind: dict[tuple[int, int], tuple[dict, dict]] = defaultdict(lambda: ({}, {}))
        for h, slot, by_size in [*((h, slot, self.by_size) for h, slot in readings), (number, None, self.exact)]:
            for n, (bits, keys, table) in by_size.items():
                x = windows(h, n)
                maybe = np.flatnonzero(bits[(x >> np.uint64(44)).astype(np.int64)])
                maybe = maybe[np.isin(x[maybe], keys)]
                doc = np.searchsorted(starts, maybe, "right") - 1
                for p, d in zip(maybe.tolist(), doc.tolist(), strict=True):
                    if p + n <= starts[d + 1]:
                        mine = [bare(w) for w in flat[p : p + n]]
                        for i, at, slots in table[int(x[p])]:
                            if mine == self.items[i][1][at : at + n] if slot is None else self._agrees(i, at, slots, mine, slot[p : p + n].tolist(), bind[d, i]):
                                cover[d, i].update(range(at, at + n))
        out: list[list[tuple[int, int, int, int, bool]]] = [[] for _ in texts]
        for (d, i), c in sorted(cover.items()):
            changed = sum(w != v for (_, w), v in bind[d, i][0].items())
            out[d].append((self.items[i][0], len(c), len(self.items[i][1]), changed, changed > 0))
        return out

    def _agrees(self, i: int, at: int, slots: np.ndarray, mine: list[str], kinds: list[int], bound: tuple[dict, dict]) -> bool:
        """Whether the words are those of the item's window, and its slots' values map one to one onto the document's, as in
        the windows before; then the new pairs are kept."""
        words = self.items[i][1]
        there, back = dict(bound[0]), dict(bound[1])
        for q, (v, k) in enumerate(zip(mine, kinds, strict=True)):
            w = words[at + q]
            if k != slots[at + q] or not k and w != v:
                return False
            if k and (there.setdefault((k, w), v) != v or back.setdefault((k, v), w) != w):
                return False
        bound[0].update(there)
        bound[1].update(back)
        return True


#: What a match has.
MATCH = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (
    ("item_id", T.LongType()), ("covered", T.LongType()), ("item_words", T.LongType()), ("changed_slots", T.LongType()), ("reparameterised", T.BooleanType()))]))


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    keep: Sequence[str] = ("doc_id",),
    window: int = 8,
    literal: int = 4,
    block_bytes: int = 1 << 20,
) -> DataFrame:
    """`keep` columns with `leaks`, the benchmark items of which the whole text holds a window.

    Every window of `window` words (all words of a shorter item) is looked up word for word, case and edge punctuation
    aside; an item of one to three words, which tells nothing inside a text, is only found as a document's whole text. For
    changed copies, numbers, units and names become typed placeholders; windows of canonical words with `literal` words
    besides placeholders are looked up by their hash, then compared word by word; the same value of an item's slot must
    meet the same value in the document and the other way round, across all the item's windows, so a re-parameterised
    question is caught and a chance mixture is not.

    The benchmark is broadcast in blocks of about block_bytes of text (their windows take some hundred times that in a
    worker): one block is the rule, and however many there are, each is held against all documents. Null texts and items
    hold nothing; a repeated item counts as often as it stands there; documents without words have no leaks; an empty
    table on either side gives no leaks. A kept column named leaks is replaced.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("item_id is not null")
    sizes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-sizes // block_bytes))
    out = docs.withColumn("__tl_leaks", F.array().cast(MATCH)) if blocks > 1 else docs
    names = [c for c in keep if c.lower() != "leaks"]
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect() if blocks > 1 else items.collect()
        shared = docs.sparkSession.sparkContext.broadcast(sorted((r.item_id, r.text) for r in rows))

        def factory(shared=shared):
            t = Templates(shared.value, window, literal)
            codes, names = Codes(t.vocabulary, t.common), [f.name for f in MATCH.elementType.fields]
            return lambda texts: [[[dict(zip(names, x, strict=True)) for x in got] for got in t.match(codes, texts)]]

        if blocks == 1:
            return map_text(out, text_col, names, [("leaks", MATCH)], factory)
        own = list(dict.fromkeys([*names, text_col, "__tl_leaks"]))
        out = map_text(out, text_col, own, [("__tl_more", MATCH)], factory).withColumn("__tl_leaks", F.concat("__tl_leaks", "__tl_more")).drop("__tl_more")
    return out.select(*names, F.col("__tl_leaks").alias("leaks"))

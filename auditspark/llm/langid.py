"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text accepts every substring of it. A text is parsed greedily: the longest
match from the current place is one phrase, and the parse starts again behind it. The language that needs the fewest
phrases, weighed by the bits that name one, wins. Windows of texts are parsed side by side in numpy, with one table for all
languages, as if a phrase began with each. Then the phrase that really reaches into a window is followed until it ends where
one of the window's own does; from there on both parses are the same, so phrases are those of the whole text. The table has
the letters that are most frequent; transitions by all others, few beside it whatever the scripts, are a sorted list.

The model is fitted on a bounded sample: of each language the DOCS documents with the smallest hashes of their id, CHARS code
points of each. Nulls and odd input: a null text, or one without a letter, is ``und`` with score 0; letters that the sample
doesn't have match nothing, not even each other; of languages that need equally much the first by name wins; of texts of one
id the smallest is learned from; without any labelled row every text is ``und``; a null id is held out if the checksum of the
empty text says so; an empty table gives an empty result; more columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

DOCS, CHARS = 24, 1500
WINDOW = 512
#: Symbols of the table; those from here on are in the list of rare ones.
SYMBOLS = 64
END = np.uint32(1 << 31)
UNKNOWN = "und"
#: Letters parsed at a time in one task.
STEP = 1 << 20


def remainder(id_col: str, n: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(n))


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton whose paths from state 0 are the substrings of symbols."""
    step, link, size, last = [{}], [-1], [0], 0
    for s in symbols:
        new = len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and s not in step[p]:
            step[p][s] = new
            p = link[p]
        if p >= 0:
            q = step[p][s]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and step[p].get(s) == q:
                    step[p][s] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Model:
    """languages; letters: symbol of each code point; table: next place of (state, symbol), with END where a phrase ends;
    keys, to: the transitions of states by rare symbols, sorted."""

    def __init__(self, texts: dict[str, str]):
        self.languages = sorted(texts)
        seen: dict[str, int] = {}
        for text in texts.values():
            for x in text.lower():
                if x.isalpha():
                    seen[x] = seen.get(x, 0) + 1
        known = sorted(sorted(seen), key=lambda x: -seen[x])
        self.letters = {ord(x): i + 2 for i, x in enumerate(known)}  # 0: between words, 1: a letter that isn't known
        self.size = max(SYMBOLS, len(known) + 2)
        tables, rare, self.roots, self.alone, self.bits, at = [], [], [], [], [], 0
        for name in self.languages:
            symbols = self.symbols(texts[name])
            states = suffix_automaton(symbols.tolist())
            table = np.zeros((len(states) + 1, SYMBOLS), np.uint32)
            alone = at + len(states) * SYMBOLS  # a symbol that the language doesn't have is a phrase of its own
            again = np.full(SYMBOLS, alone, np.uint32)
            for s, to in states[0].items():
                if s < SYMBOLS:
                    again[s] = at + to * SYMBOLS
            table[:] = again | END
            table[0] = again
            for i, out in enumerate(states):
                for s, to in out.items():
                    if s < SYMBOLS:
                        table[i, s] = at + to * SYMBOLS
                    else:
                        rare.append(((at // SYMBOLS + i) * self.size + s, at + to * SYMBOLS))
            tables.append(table)
            self.roots.append(at)
            self.alone.append(alone)
            self.bits.append(np.log2(max(2, len(symbols))))
            at += table.size
        self.table = np.concatenate([x.ravel() for x in tables]) if tables else np.zeros(SYMBOLS, np.uint32)
        rare.sort()
        self.keys, self.to = np.array([k for k, _ in rare], np.int64), np.array([x for _, x in rare], np.uint32)

    def lookup(self) -> np.ndarray:
        if not hasattr(self, "_lookup"):
            self._lookup = np.zeros(0x110000, np.uint32)
            self._lookup[[i for i in range(0x110000) if chr(i).isalpha()]] = 1
            for i, s in self.letters.items():
                self._lookup[i] = s
        return self._lookup

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_lookup", "_edge_of")}

    def symbols(self, text: str) -> np.ndarray:
        """Letters in lower case; whatever lies between words is one symbol."""
        s = self.lookup()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = s > 0
        if len(s):
            keep[1:] |= s[:-1] > 0
        return s[keep]

    def _edges(self, places: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether there is a transition by a rare symbol, and where it goes."""
        wanted = places // SYMBOLS * self.size + symbols
        i = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return self.keys[i] == wanted, self.to[i]

    def _rare(self, places: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """What the table would hold for rare symbols."""
        root = np.array(self.roots, np.int64)[:, None]
        begins, first = self._edges(root, symbols)
        again = np.where(begins, first, np.array(self.alone, np.uint32)[:, None])
        goes, to = self._edges(places, symbols)
        return np.where(goes, to, np.where(places == root, again, again | END))

    def _windows(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """windows (longest first) as columns of symbols -> by language: where each ends up, and whether a phrase ended before each symbol."""
        place = np.repeat(np.array(self.roots, np.int64)[:, None], windows.shape[1], 1)
        marks = np.zeros((len(self.roots), *windows.shape), bool)
        live = len(lengths) - np.searchsorted(lengths[::-1], np.arange(windows.shape[0]), "right")
        for i in range(int(lengths[0]) if len(lengths) else 0):
            k = live[i]
            symbols = windows[i, :k]
            rare = np.flatnonzero(symbols >= SYMBOLS)
            if len(rare):
                v = self.table.take(place[:, :k] + np.where(symbols < SYMBOLS, symbols, 1))
                v[:, rare] = self._rare(place[:, rare], symbols[rare])
            else:
                v = self.table.take(place[:, :k] + symbols)
            marks[:, i, :k] = v >= END
            place[:, :k] = v & ~END
        return place, marks

    def phrases(self, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """windows (longest first) as columns of symbols -> phrases of each, by language."""
        place, marks = self._windows(windows, lengths)
        return marks.sum(1) + (place != np.array(self.roots)[:, None])

    def _one(self, language: int, place: int, symbol: int) -> int:
        """What the table would hold for a rare symbol."""
        if not hasattr(self, "_edge_of"):
            self._edge_of = dict(zip(self.keys.tolist(), self.to.tolist()))
        root = self.roots[language]
        v = self._edge_of.get(place // SYMBOLS * self.size + symbol)
        if v is None:
            v = self._edge_of.get(root // SYMBOLS * self.size + symbol, self.alone[language])
            v += 0 if place == root else int(END)
        return v

    def count(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (symbols), by language."""
        counts = [-(-len(s) // WINDOW) for s in texts]
        lengths = np.concatenate([np.append(np.full(c - 1, WINDOW), len(s) - WINDOW * (c - 1)) for c, s in zip(counts, texts)])
        order = np.argsort(-lengths, kind="stable")
        block = np.zeros((len(lengths), WINDOW), np.uint32)
        block[np.arange(WINDOW) < lengths[:, None]] = np.concatenate(texts)
        place, marks = np.empty((len(self.roots), len(lengths)), np.int64), np.empty((len(self.roots), len(lengths), WINDOW), bool)
        place[:, order], found = self._windows(np.ascontiguousarray(block[order].T), lengths[order])
        marks[:, order] = found.transpose(0, 2, 1)
        ends = marks.sum(2)
        marks[:, :, 0] = True  # where a window's own parse begins
        out, first, n = np.empty((len(self.roots), len(texts)), np.int64), 0, lengths.tolist()
        for i, c in enumerate(counts):
            symbols = block[first : first + c]
            for j in range(len(self.roots)):
                out[j, i] = self._join(j, symbols, n[first : first + c], place[j, first : first + c].tolist(), ends[j, first : first + c].tolist(), marks[j, first : first + c])
            first += c
        return out

    def _join(self, language: int, symbols, lengths, places, ends, marks) -> int:
        """Phrases of a text from those of its windows: where the true parse and a window's own meet, the rest is the same."""
        table, end, total, at = memoryview(self.table), int(END), ends[0] + 1, places[0]
        for w in range(1, len(lengths)):
            row, mark = symbols[w].tolist(), marks[w].tobytes()
            for i in range(lengths[w]):
                s = row[i]
                v = table[at + s] if s < SYMBOLS else self._one(language, at, s)
                if v < end:
                    at = v
                    continue
                total, at = total + 1, v - end
                if mark[i]:
                    total, at = total + mark.count(1, i + 1), places[w]
                    break
        return total

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.languages:
            return out
        held, size = [], 0
        for i, text in enumerate(texts):
            if text:
                s = self.symbols(text)
                if s.any():
                    held.append((i, s))
                    size += len(s)
            if held and (size > STEP or i == len(texts) - 1):
                self._parse(held, out)
                held, size = [], 0
        if held:
            self._parse(held, out)
        return out

    def _parse(self, held, out) -> None:
        need = self.count([s for _, s in held]) * np.array(self.bits)[:, None]
        for j, (i, _) in enumerate(held):
            best = int(np.argmin(need[:, j]))
            rest = np.delete(need[:, j], best).min() if len(self.languages) > 1 else 2 * need[best, j]
            out[i] = (self.languages[best], float(rest / (rest + need[best, j])))


def fit(docs: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang", docs_each: int = DOCS, chars: int = CHARS) -> Model:
    """docs: labelled rows. The sample holds at most docs_each * chars code points a language."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("l"), F.col(text_col).alias("t")).filter(F.col("l").isNotNull() & (F.length("t") > 0))
    ranked = rows.select("id", "l").withColumn("h", F.xxhash64("id"))
    ids = ranked.withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy("h", "id"))).filter(F.col("k") <= docs_each).select(F.col("id").alias("of"), F.col("l").alias("in"), "k").distinct()
    picked = rows.join(F.broadcast(ids), F.col("id").eqNullSafe(F.col("of")) & (F.col("l") == F.col("in")))
    picked = picked.groupBy("l", "k").agg(F.min(F.substring("t", 1, chars)).alias("t")).collect()
    texts: dict[str, list] = {}
    for r in sorted(picked, key=lambda r: (r["l"], r["k"])):
        texts.setdefault(r["l"], []).append(r["t"])
    return Model({name: " ".join(t) for name, t in texts.items()})


def predictor(docs: DataFrame, model: Model):
    """A function of a text column: struct of lang_pred and score."""
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(texts: pa.Array) -> pa.Array:
        found = shared.value.predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang", parts: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Learns from rows whose checksum of the id isn't held modulo parts."""
    model = fit(docs.filter(remainder(id_col, parts) != held), id_col=id_col, text_col=text_col, lang_col=lang_col)
    out = docs.select(F.col(id_col).alias("doc_id"), (remainder(id_col, parts) == held).alias("held_out"), predictor(docs, model)(text_col).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, parts: int = 4, held: int = 2) -> DataFrame:
    """docs without the texts whose language is ``und``."""
    model = fit(docs.filter(remainder("doc_id", parts) != held))
    return docs.filter(predictor(docs, model)("text")["lang_pred"] != UNKNOWN)

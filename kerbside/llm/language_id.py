"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled
text.  A text is parsed greedily into the longest phrases that occur in a
language's sample; the language that needs fewest phrases for the text's length
wins.  Texts are lower-cased, runs of letters are kept and joined by one space.

Their UTF-8 bytes are parsed whole.  So that one vectorised step advances many
texts in all languages, a text is cut in blocks, each of which is parsed as if
a phrase began with it, and then put right: from the state in which the block
before ends the parse goes on into the block until a phrase ends where one ends
in the block's own parse too; from there on both are the same.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, map_arrow

BLOCK = 512
_RUN = re.compile(r"[^\W\d_]+")
_ENDED = np.int32(1 << 30)


def letters(text: str | None) -> str:
    """The runs of letters of the text in lower case, joined by a space."""
    out = " ".join(_RUN.findall((text or "").lower()))
    if out and not out.replace(" ", "").isalpha():
        out = " ".join("".join(c if c.isalpha() else " " for c in out).split())
    return out


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings of `data`; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


def count_phrases(automaton: list[dict[int, int]], data: bytes) -> int:
    """Phrases of the greedy parse; the plain form of what Model.phrases does."""
    state, n = 0, 1 if data else 0
    for c in data:
        if c in automaton[state]:
            state = automaton[state][c]
        else:
            n += 1
            state = automaton[0].get(c, 0)
    return n


class Model:
    """Transition tables of all languages in one array."""

    def __init__(self, samples: dict[str, list[str]], sample_bytes: int, table_bytes: int = 1 << 28) -> None:
        self.languages = sorted(samples)
        data = {k: " ".join(samples[k]).encode() for k in self.languages}
        used = sorted(set(b"".join(data.values())))
        self.symbols = len(used) + 2  # the last two: a byte that no sample has, and no byte at all
        self.symbol = np.full(256, len(used), np.uint8 if self.symbols < 256 else np.uint16)
        self.symbol[used] = np.arange(len(used))
        fit = table_bytes // (8 * self.symbols * max(1, len(self.languages)))
        tables, self.start, at = [], [], 0
        for k in self.languages:
            automaton = suffix_automaton(data[k][: min(sample_bytes, fit)])
            table = np.full((len(automaton), self.symbols), -1, np.int32)
            for state, to in enumerate(automaton):
                for c, target in to.items():
                    table[state, self.symbol[c]] = at + target
            again = np.where(table[0] >= 0, table[0], at) | _ENDED
            table = np.where(table >= 0, table, again)
            table[:, -1] = np.arange(at, at + len(automaton))
            tables.append(table)
            self.start.append(at)
            at += len(automaton)
        self.table = np.concatenate(tables).reshape(-1) if tables else np.zeros(0, np.int32)

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """int64 [texts, languages]: phrases of each text in each language."""
        size = np.array([len(t) for t in texts], np.int64)
        blocks = -(-size // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        if not len(owner) or not self.languages:
            return out
        data = np.full((len(owner), BLOCK), self.symbols - 1, self.symbol.dtype)
        first = np.cumsum(blocks) - blocks
        flat, raw = data.reshape(-1), self.symbol[np.frombuffer(b"".join(texts), np.uint8)]
        at = 0
        for f, n in zip(first, size, strict=True):
            flat[f * BLOCK : f * BLOCK + n] = raw[at : at + n]
            at += n
        columns = np.ascontiguousarray(data.T).astype(np.int32)
        state = np.repeat(np.array(self.start, np.int32)[:, None], len(owner), axis=1)
        count = np.zeros(state.shape, np.int32)  # phrases that end within each block
        ends = np.zeros((BLOCK, *state.shape), bool)
        place, found = np.empty_like(state), np.empty_like(state)
        for row, end in zip(columns, ends, strict=True):
            np.multiply(state, np.int32(self.symbols), out=place)
            np.add(place, row[None, :], out=place)
            np.take(self.table, place, out=found, mode="wrap")
            np.bitwise_and(found, _ENDED - 1, out=state)
            np.right_shift(found, 30, out=found)
            np.add(count, found, out=count)
            np.copyto(end, found, casting="unsafe")
        # blocks whose text goes on in the next one
        goes_on = np.flatnonzero(owner[:-1] == owner[1:])
        lang, block = (x.ravel() for x in np.meshgrid(np.arange(len(self.languages)), goes_on + 1, indexing="ij"))
        while len(block):
            lang, block = self._put_right(columns, ends, state, count, lang, block)
            more = block + 1 < len(owner)
            more[more] = owner[block[more] + 1] == owner[block[more]]
            lang, block = lang[more], block[more] + 1
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(owner, count[k], len(texts)).astype(np.int64) + (size > 0)
        return out

    def _put_right(self, columns: np.ndarray, ends: np.ndarray, state: np.ndarray, count: np.ndarray, lang: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parses each block in its language on from the state in which the block before ends; `ends`, `state` and `count` become those of that parse.

        Returns those whose parse did not meet the former one, so that the
        block after them starts from another state than was taken.
        """
        at, now = np.arange(len(block)), state[lang, block - 1]
        for k in range(BLOCK):
            if not len(at):
                break
            x, b = lang[at], block[at]
            found = self.table[now * self.symbols + columns[k, b]]
            end, was = found >> 30 > 0, ends[k, x, b]
            count[x, b] += end.astype(np.int32) - was
            ends[k, x, b] = end
            apart = ~(end & was)
            at, now = at[apart], (found & (_ENDED - 1))[apart]
        state[lang[at], block[at]] = now
        return lang[at], block[at]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Languages and scores; `und` and 0 for a text without letters or where nothing was learned.

        The score is one less the ratio of phrases in the best language to the
        second best; ties go to the language first in order.
        """
        plain = [letters(t).encode("utf-8", "surrogatepass") for t in texts]
        counts = self.phrases(plain)
        langs, scores = [], []
        for t, row in zip(plain, counts, strict=True):
            if not t or not self.languages:
                langs.append("und")
                scores.append(0.0)
                continue
            best = int(np.argmin(row))
            rest = np.delete(row, best)
            langs.append(self.languages[best])
            scores.append(float(1 - row[best] / rest.min()) if len(rest) else 1.0)
        return langs, scores


def learn(labelled: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", *, sample_rows: int = 96, row_chars: int = 2000, sample_bytes: int = 20_000, table_bytes: int = 1 << 28) -> Model:
    """A model from a bounded sample: the `sample_rows` different texts of each language that a hash of the text puts first, at most
    `row_chars` characters of each, at most `sample_bytes` bytes of normalised text for each language.

    All transition tables together take at most `table_bytes`: beyond some 100
    languages each learns from fewer bytes.  Rows with a null language or text,
    and texts without a letter, teach nothing.  Ids don't matter, so they may be
    null or repeated; copies of a text count once, so that no language is lost
    or learned from one text while it has others.  What reaches the driver is
    bounded by the number of languages times these parameters.
    """
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("l is not null").where(F.col("t").rlike(r"\p{L}"))
    rows = rows.withColumn("o", F.xxhash64("t", "l"))
    counts = {r.l: r.n for r in rows.groupBy("l").agg(F.approx_count_distinct("o", 0.05).alias("n")).collect()}
    if not counts:
        return Model({}, sample_bytes)
    # four times as many as are taken, so that an estimate that is off leaves enough
    below = F.lit(0)
    for k, n in counts.items():
        below = F.when(F.col("l") == k, F.lit(min(1 << 30, ((4 * sample_rows) << 30) // max(n, 1) + 1))).otherwise(below)
    some = rows.where(F.shiftrightunsigned("o", 34) < below).select("l", "o", F.left("t", F.lit(row_chars)).alias("t"))
    distinct = some.groupBy("l", "o").agg(F.min("t").alias("t"))
    first = Window.partitionBy("l").orderBy("o", "t")
    picked = distinct.withColumn("r", F.row_number().over(first)).where(F.col("r") <= sample_rows).select("l", "o", "t").collect()
    samples: dict[str, list[str]] = {k: [] for k in counts}
    for r in sorted(picked, key=lambda r: (r.l, r.o, r.t)):
        if sum(map(len, samples[r.l])) < sample_bytes and (t := letters(r.t)):
            samples[r.l].append(t)
    return Model({k: v for k, v in samples.items() if v}, sample_bytes, table_bytes)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id_col, *keep, lang_pred, score), one for each row of `docs`; nothing but the text decides.

    Texts that are null or have no letter get `und` and 0; texts of any length
    are parsed whole.  Ids may be null or repeated, equal texts get equal languages; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in (id_col, *keep)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = shared.value.predict(batch.column("_text").to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*(f.name for f in fields), "lang_pred", "score"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return map_arrow(docs.select(*(f.name for f in fields), F.col(text).alias("_text")), run, f"{ddl}, lang_pred string, score double", "_text")


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(fold(id_col) % 4 == 2, F.lit(False))

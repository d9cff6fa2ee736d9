"""License scans: exact phrases, and an exact set-similarity join of text blocks with license templates.

A template is a set of words. The document frequencies of the templates' words, counted over all texts, order
every template rare-first. A block can hold enough of a template only if it holds one of its first
m - ceil(threshold * m) + 1 words: these are the template's prefix, and an index from prefix words to templates
joins the words of a text with the templates (prefix filter). The positional filter judges each meeting before
anything is counted: if the place is that of the rarest word a block holds, all its other template words come later
in the order, so fewer than ceil(threshold * m) words of its rank or later within reach rule the meeting out. A pair
of a text and a template whose every meeting is ruled out is never looked at again. Of the other pairs only the
blocks around a place that is left, with enough words of the template (length filter), are counted. Every block that
then holds the threshold is found, and blocks that overlap are one match.

Templates of a table are read in groups of at most `most_words` words. Each group has a scan of its own, whose tasks
hold that group alone; what it finds is stored by row, and the driver lets it go before it reads the next.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.common import Scratch, distinct_names, rows_named, scratch_of
from citeloom.llm.textarrays import Words, windows
from citeloom.llm.tokens import slices

#: Bytes between words: ASCII other than digits and small letters (capitals are folded first).
BETWEEN = np.array([b < 128 and not (48 <= b <= 57 or 97 <= b <= 122) for b in range(256)])
#: The base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Templates, as (label, words): notices in common use, and the bodies of short licenses.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished "
        "to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection "
        "with the software or the use or other dealings in the software",
    ),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind "
        "either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain "
        "the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
        "following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or "
        "implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or "
        "contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use "
        "data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out "
        "of the use of this software even if advised of the possibility of such damage",
    ),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear "
        "in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event "
        "shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
        "negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("all-rights-reserved", "all rights reserved"),
)
MATCH = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("containment", T.DoubleType())]))
_MATCH = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("containment", pa.float64())]))


def _words(texts: pa.Array) -> Words:
    return Words(texts, lower=True, between=BETWEEN)


@dataclass(frozen=True)
class Templates:
    """Templates with at least one word: their vocabulary as sorted hashes, and each one's distinct words and block size."""

    labels: tuple[str, ...]
    vocabulary: np.ndarray
    sets: tuple[np.ndarray, ...]
    spans: tuple[int, ...]

    @classmethod
    def of(cls, templates: list[tuple[str, str]], stretch: float) -> Templates:
        words = _words(pa.array([t for _, t in templates], pa.string()))
        vocabulary = np.unique(words.hash)
        kept = [i for i, n in enumerate(words.counts().tolist()) if n]
        sets = tuple(np.unique(np.searchsorted(vocabulary, words.hash[words.at[i] : words.at[i + 1]])) for i in kept)
        return cls(tuple(templates[i][0] for i in kept), vocabulary, sets, tuple(math.ceil(int(words.counts()[i]) * stretch) for i in kept))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's number in the vocabulary; -1 for other words."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)


#: Steps of the rare-first order that the positional filter tells apart, and the meetings that are judged at a time.
BANDS, MEETINGS = 8, 1 << 21


class Index:
    """Templates rare-first, and for each word of the vocabulary the templates that have it in their prefix."""

    def __init__(self, known: Templates, often: dict[int, int], threshold: float):
        self.known, n = known, len(known.vocabulary)
        count = np.array([often.get(w, 0) for w in range(n)], np.int64)
        rare = np.argsort(count, kind="stable")
        # bands of about equal frequency: a word's band and the later ones hold all words of its rank or a later one
        before = np.cumsum(count[rare]) - count[rare]
        self.band = np.empty(n, np.int64)
        self.band[rare] = before * BANDS // max(1, int(count.sum()))
        place = np.argsort(rare, kind="stable")
        self.ranks, self.need, self.spans = [], np.zeros(len(known.sets), np.int64), np.array(known.spans, np.int64)
        pairs: list[tuple[int, int]] = []
        for k, words in enumerate(known.sets):
            order = words[np.argsort(place[words])]
            self.need[k] = max(1, math.ceil(threshold * len(order) - 1e-9))
            self.ranks.append(order)
            pairs += [(w, k) for w in order[: len(order) - self.need[k] + 1].tolist()]
        pairs.sort()
        self.template = np.array([k for _, k in pairs], np.int64)
        self.first = np.searchsorted(np.array([w for w, _ in pairs], np.int64), np.arange(n + 1))

    def met(self, text_of: np.ndarray, place: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(text, template, place) where a prefix word of the template stands and the positional filter leaves a block possible, in this order; and how many meetings it ruled out.

        text_of, place, number: text, place in the batch and word of all vocabulary words of a batch, by place.
        """
        from_band = np.zeros((BANDS, len(number) + 1), np.int32)  # vocabulary words of a band or a later one before each place
        for b in range(BANDS):
            np.cumsum(self.band[number] >= b, out=from_band[b, 1:])
        size = self.first[number + 1] - self.first[number]
        has = np.flatnonzero(size)
        total = np.cumsum(size[has])
        found, ruled_out = [], 0
        for piece in np.split(has, np.searchsorted(total, np.arange(MEETINGS, int(total[-1]) if len(total) else 0, MEETINGS))):
            each = size[piece]
            at = np.repeat(piece, each)
            k = self.template[np.repeat(self.first[number[piece]] - np.cumsum(each) + each, each) + np.arange(len(at))]
            # a block with this place reaches less than its span to each side, and not into another text
            lo = np.maximum(np.searchsorted(place, place[at] - self.spans[k], side="right"), np.searchsorted(text_of, text_of[at]))
            hi = np.minimum(np.searchsorted(place, place[at] + self.spans[k]), np.searchsorted(text_of, text_of[at], side="right"))
            band = self.band[number[at]]
            left = from_band[band, hi] - from_band[band, lo] >= self.need[k]
            ruled_out += len(left) - int(left.sum())
            found.append((text_of[at[left]], k[left], place[at[left]]))
        text, k, where = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((where, k, text))
        return text[order], k[order], where[order], ruled_out

    def blocks(self, k: int, place: np.ndarray, word: np.ndarray, met: np.ndarray) -> list[tuple[int, int, float]]:
        """(first, end, containment) of the runs of overlapping blocks that hold enough of template k.

        place, word: places of vocabulary words in a text, in order, and the words; met: the places that the filters
        left. A block starts at a template word, spans known.spans[k] words and ends at its last template word.
        """
        order, need, span = self.ranks[k], int(self.need[k]), self.known.spans[k]
        by = np.sort(order)
        at = np.minimum(np.searchsorted(by, word), len(by) - 1)
        own = by[at] == word
        place, rank = place[own], np.argsort(order, kind="stable")[at[own]]
        ends = np.searchsorted(place, place + span)
        near = np.searchsorted(met, place + span) > np.searchsorted(met, place)
        starts = np.flatnonzero(near & (ends - np.arange(len(place)) >= need))  # the length filter
        out: list[list] = []
        held, distinct, lo, hi = np.zeros(len(order), np.int64), 0, 0, 0
        for i in starts.tolist():
            if i >= hi:
                held[:], distinct, lo, hi = 0, 0, i, i
            while lo < i:
                held[rank[lo]] -= 1
                distinct -= held[rank[lo]] == 0
                lo += 1
            while hi < ends[i]:
                distinct += held[rank[hi]] == 0
                held[rank[hi]] += 1
                hi += 1
            if distinct >= need:
                a, b, share = int(place[i]), int(place[ends[i] - 1]) + 1, distinct / len(order)
                if out and a < out[-1][1]:
                    out[-1][1], out[-1][2] = max(out[-1][1], b), max(out[-1][2], share)
                else:
                    out.append([a, b, share])
        return [tuple(x) for x in out]

    def found(self, words: Words, n: int) -> list[list[dict]]:
        """The matches of each of a batch's n texts."""
        out: list[list[dict]] = [[] for _ in range(n)]
        number = self.known.numbers(words.hash)
        place = np.flatnonzero(number >= 0)
        number, text_of = number[place], np.searchsorted(words.at, place, side="right") - 1
        edges = np.searchsorted(text_of, np.arange(n + 1))
        text, template, met, _ = self.met(text_of, place, number)
        cuts = np.flatnonzero(np.diff(text) | np.diff(template)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(text)], strict=True):
            if lo < hi:
                t, k = int(text[lo]), int(template[lo])
                start, here = int(words.at[t]), slice(edges[t], edges[t + 1])
                for a, b, share in self.blocks(k, place[here] - start, number[here], met[lo:hi] - start):
                    out[t].append({"label": self.known.labels[k], "first_word": a, "end_word": b, "containment": share})
        return out


def word_frequencies(docs: DataFrame, text: str, known: Templates) -> DataFrame:
    """word (its number) and n_docs over all texts, for the templates' words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known.vocabulary), np.int64)
        for batch in batches:
            for part in slices(batch, 0, 4 << 20):
                words = _words(part.column(0))
                number = known.numbers(words.hash)
                at = np.flatnonzero(number >= 0)
                text_of = np.searchsorted(words.at, at, side="right") - 1
                seen = np.unique(text_of * len(total) + number[at])
                total += np.bincount(seen % max(1, len(total)), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["word", "n"])

    return docs.select(text).mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n_docs"))


def groups_of(templates: Iterable[tuple[str, str]], most_words: int) -> Iterator[list[tuple[str, str]]]:
    """Templates in groups of at most most_words words each, one group at a time; a longer template is a group of its own."""
    out, held = [], 0
    for label, words in templates:
        n = len(words.split())
        if out and held + n > most_words:
            yield out
            out, held = [], 0
        out.append((label, words))
        held += n
    yield out


def _phrase_places(words: Words, n: int, sought: list[tuple[str, int, int]]) -> tuple[list[list[int]], list[set[str]]]:
    """The starts of all phrases in each of n texts, and their labels."""
    starts: list[list[int]] = [[] for _ in range(n)]
    base: list[set] = [set() for _ in range(n)]
    for length in {s[1] for s in sought}:
        grams = windows(words.hash, length)
        for label, _, target in (s for s in sought if s[1] == length):
            for at in np.flatnonzero(grams == target).tolist():
                t = int(np.searchsorted(words.at, at, side="right")) - 1
                if at + length <= words.at[t + 1]:
                    starts[t].append(at - int(words.at[t]))
                    base[t].add(label)
    return starts, base


def _matches(docs: DataFrame, names: list[str], text: str, index: Index) -> DataFrame:
    """names and matches of the rows in which a template of the index is found."""
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("matches", MATCH)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(names), 4 << 20):
                found = index.found(_words(part.column(len(names))), part.num_rows)
                hit = pa.array([i for i, f in enumerate(found) if f], pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(hit) for i in range(len(names))), pa.array([f for f in found if f], _MATCH)], names=schema.names)

    return docs.select(*names, text).mapInArrow(scan, schema)


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, templates: DataFrame | tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.9, stretch: float = 1.5,
    most_words: int = 2_000_000, scratch: Scratch | None = None,
) -> DataFrame:
    """Per row: the id, n_words, n_base, first_word, last_word, base_labels, labels, score and matches.

    n_base counts the places of the phrases, first_word and last_word are the least and largest start. templates:
    (label, words), as a table or a tuple; ones without words match nothing, and null rows are left out. matches
    has every text block that holds at least `threshold` of a template's distinct words within stretch * (its
    words) words, from the first to the last template word in it; blocks of one template that overlap are one, with
    the largest containment. A match adds its label. score: 1 with a phrase, else the largest containment found,
    else 0. Null and empty texts have no words and no labels ('' and ''), first and last word null. A text of any
    length is scanned whole. Repeated rows get equal results; an empty table gives an empty table. Other columns,
    whatever their names, are not read; an id column named like an output is an error.

    The driver and a task hold at most `most_words` words of templates, or one longer template. More templates take a scan
    of docs for each group, and the rows' matches, without their texts, are joined by file and place.
    """
    outputs = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")
    distinct_names({id_col}, outputs)
    if isinstance(templates, DataFrame):
        label, template = templates.columns[:2]
        templates = ((r[0], r[1]) for r in templates.select(label, template).dropna().distinct().orderBy(label, template).toLocalIterator())
    groups = groups_of(templates, most_words)
    group, following = next(groups), next(groups, None)
    names: list[str] = []
    if following is not None:
        scratch = scratch_of(docs, scratch, "licenses")
        docs, names = rows_named(docs, scratch)

    def indexed(group: list[tuple[str, str]]) -> Index:
        known = Templates.of(group, stretch)
        often = {r["word"]: r["n_docs"] for r in word_frequencies(docs, text, known).collect()} if len(known.vocabulary) else {}  # one row a template word
        return Index(known, often, threshold)

    stored = []
    while following is not None:
        stored.append(scratch.stored(_matches(docs, names, text, indexed(group)), "matches"))
        group, following = following, next(groups, None)
    index = indexed(group)
    wanted = _words(pa.array(list(phrases), pa.string()))
    sought = [(label, int(b - a), windows(wanted.hash[a:b], int(b - a))[0]) for label, a, b in zip(phrases.values(), wanted.at[:-1], wanted.at[1:], strict=True)]
    given = [*names, id_col]
    out = [*(docs.schema[c] for c in given), *(T.StructField(c, T.LongType()) for c in outputs[:4]), T.StructField("base_labels", T.ArrayType(T.StringType())), T.StructField("matches", MATCH)]
    schema = T.StructType(out)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(given), 4 << 20):
                words, n = _words(part.column(len(given))), part.num_rows
                starts, base = _phrase_places(words, n, sought)
                edge = lambda f: pa.array([f(s) if s else None for s in starts], pa.int64())  # noqa: B023, E731
                columns = [pa.array(words.counts().astype(np.int64)), pa.array([len(s) for s in starts], pa.int64()), edge(min), edge(max)]
                columns += [pa.array([sorted(b) for b in base], pa.list_(pa.string())), pa.array(index.found(words, n), _MATCH)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(given))), *columns], names=schema.names)

    rows = docs.select(*given, text).mapInArrow(scan, schema)
    if stored:
        more = reduce(DataFrame.unionAll, stored).groupBy(*names).agg(F.flatten(F.collect_list("matches")).alias("__more"))
        none = F.array().cast(MATCH)
        rows = rows.join(more, names, "left").withColumn("matches", F.concat("matches", F.coalesce("__more", none)))
    labels = F.array_sort(F.array_union("base_labels", F.transform("matches", lambda m: m["label"])))
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))
    score = F.when(F.size("base_labels") > 0, 1.0).otherwise(best)
    return rows.select(id_col, *outputs[:4], F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), F.array_sort("matches").alias("matches"))

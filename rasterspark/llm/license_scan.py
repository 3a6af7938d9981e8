"""License scans by conditional compression.

Candidate blocks are runs of words around anchors of the templates (a few words in a row, so many of each template that a
text with its wording has one of them whole), and lines with a licensing cue. A block's words are compressed with each
template as a zstandard raw dictionary. Templates that save of no stretch of it a good share of what they save of themselves are rejected; a
block that none is left for is dropped. In the order of what they save, the others are compared with the block word by
word; the first whose wording is there is the block's licence. What lies before and after its words is a block again, so
licences side by side are all found. A block without a confirmed template is kept, unnamed, where the best one saves a
good share of it. Templates are a parameter; NOTICES holds public notices, short ones and whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from difflib import SequenceMatcher
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, small_batches

CUE = r"(?i)licen[sc]|copyright|\(c\) ?[0-9]{4}|redistribut|without warrant|as is|spdx|public domain|all rights reserved"
#: Whatever CUE finds holds one of these, in lower case.
CUE_PARTS = ("licen", "copyright", "(c)", "redistribut", "without warrant", "as is", "spdx", "public domain", "all rights reserved")
#: Wording of public licence notices.
NOTICES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS",
    ),
}
#: Share of a template's words that may be missing from a block, or stand between its words there.
SLACK = 0.1
ANCHOR = 3
#: Least share of a block's compressed size that the best template saves if the block is kept without a licence.
LIKELY = 0.2
#: Least share of what a template saves of its own words that it saves of a block it is compared with.
SAVES = 0.25
#: Blocks whose ranks are remembered in a task: short notices repeat.
REMEMBERED = 4096
_WORD = re.compile(r"\w+(?:[.-]\w+)*")


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def anchors(template: list[str]) -> list[int]:
    """Places of disjoint runs of ANCHOR words, the longest words first: one more than the words that may be missing or
    added, each of which breaks one run at most."""
    size = min(ANCHOR, len(template))
    out: list[int] = []
    for k in sorted(range(len(template) - size + 1), key=lambda k: -len("".join(template[k : k + size]))):
        if len(out) <= int(SLACK * len(template)) and all(abs(k - j) >= size for j in out):
            out.append(k)
    return out if template else []


def anchor_pattern(notices: dict[str, tuple[str, ...]]) -> str:
    """Finds every text that has an anchor of a template."""
    runs = {r"\W+".join(map(re.escape, words[k : k + ANCHOR])) for texts in notices.values() for words in map(words_of, texts) for k in anchors(words)}
    return "(?i)" + "|".join(sorted(runs))


def may_hold(low: Column, notices: dict[str, tuple[str, ...]]) -> Column:
    """True for every lower-cased text with a cue or an anchor, and for some others: the two longest words of an anchor are
    looked for, by plain search."""
    pairs: dict[str, set[str]] = {}
    for words in (words_of(t) for texts in notices.values() for t in texts):
        for k in anchors(words):
            long = sorted(words[k : k + ANCHOR], key=lambda w: (-len(w), w))
            pairs.setdefault(long[0], set()).add(long[min(1, len(long) - 1)])
    found = [F.contains(low, F.lit(c)) for c in CUE_PARTS]
    found += [F.contains(low, F.lit(w)) & reduce(Column.__or__, [F.contains(low, F.lit(v)) for v in sorted(others)]) for w, others in sorted(pairs.items())]
    return reduce(Column.__or__, found)


def cue_spans(text: str) -> list[tuple[int, int]]:
    """Begin and end of each run of lines with a cue."""
    out: list[tuple[int, int]] = []
    at = 0
    for line in text.split("\n"):
        if re.search(CUE, line):
            if out and out[-1][1] == at - 1:
                out[-1] = (out[-1][0], at + len(line))
            else:
                out.append((at, at + len(line)))
        at += len(line) + 1
    return out


def wording(template: list[str], block: list[str]) -> tuple[list[str], list[str]]:
    """Words of the template that the block lacks, and words that the block has between the template's."""
    same = [m for m in SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
    if not same:
        return template, []
    lost, at = [], 0
    for m in same:
        lost += template[at : m.a]
        at = m.a + m.size
    lost += template[at:]
    extra = [w for m, n in zip(same, same[1:], strict=False) for w in block[m.b + m.size : n.b]]
    return lost, extra


class Scanner:
    """Compressors for every template of every licence."""

    def __init__(self, notices: dict[str, tuple[str, ...]]):
        import zstandard

        self.plain = zstandard.ZstdCompressor(level=3)
        self.templates = []
        self.pattern = re.compile(anchor_pattern(notices))
        self.anchors: dict[tuple[str, ...], list[tuple[int, int]]] = {}
        self.bounds: list[float] = []
        for name, texts in sorted(notices.items()):
            for text in texts:
                words = words_of(text)
                own = " ".join(words)
                raw = zstandard.ZstdCompressionDict(own.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                for k in anchors(words):
                    self.anchors.setdefault(tuple(words[k : k + ANCHOR]), []).append((len(self.templates), k))
                self.templates.append((name, words, zstandard.ZstdCompressor(level=3, dict_data=raw)))
                self.bounds.append(SAVES * self.saving(len(self.templates) - 1, own))
        self.sizes = {len(a) for a in self.anchors}
        self.rank = lru_cache(REMEMBERED)(self.rank)

    def saving(self, t: int, block: str) -> int:
        """Bytes that template t saves of a block of words."""
        raw = block.encode()
        return len(self.plain.compress(raw)) - len(self.templates[t][2].compress(raw))

    def most_saved(self, t: int, words: list[str]) -> int:
        """The most that template t saves of a stretch of words; a near wording lies whole in one of the stretches."""
        n = max(1, len(self.templates[t][1]) + int(SLACK * len(self.templates[t][1])))
        return max(self.saving(t, " ".join(words[i : i + 2 * n])) for i in range(0, max(1, len(words) - n), n))

    def rank(self, block: str) -> list[tuple[int, int]]:
        """Templates that save enough of a block of words, as bytes and place, most first; ties in the templates' order."""
        words = block.split(" ")
        found = sorted((-self.most_saved(t, words), t) for t in range(len(self.templates)))
        return [(-lost, t) for lost, t in found if -lost >= self.bounds[t]]

    def confirm(self, t: int, words: list[str], first: int, last: int) -> tuple[int, int, list[str], list[str]] | None:
        """The place in words[first:last] with template t's wording, and words missing and added; None if none is near
        enough. Places come from its anchors, one of which stands whole wherever its wording is."""
        _, template, _ = self.templates[t]
        slack, best = int(SLACK * len(template)), None
        size = min(ANCHOR, len(template))
        for i in range(first, last - size + 1):
            for k in (k for u, k in self.anchors.get(tuple(words[i : i + size]), ()) if u == t):
                start = max(i - k - slack, first)
                window = words[start : min(i - k + len(template) + slack, last)]
                lost, extra = wording(template, window)
                if len(lost) + len(extra) <= SLACK * len(template) and (best is None or len(lost) + len(extra) < len(best[2]) + len(best[3])):
                    same = [m for m in SequenceMatcher(None, template, window, autojunk=False).get_matching_blocks() if m.size]
                    best = (start + same[0].b, start + same[-1].b + same[-1].size, lost, extra)
        return best

    def blocks(self, text: str, words: list[str], places: list[re.Match]) -> list[tuple[int, int]]:
        """Runs of words that may hold a notice, in order: around anchors, and lines with a cue. Runs that overlap are one
        up to a few templates' length; a longer one begins anew, with the whole window of its first anchor."""
        spans, most = [], 4 * max((len(t) for _, t, _ in self.templates), default=1)
        for i in range(len(words)):
            for size in self.sizes:
                for t, k in self.anchors.get(tuple(words[i : i + size]), ()):
                    n, slack = len(self.templates[t][1]), int(SLACK * len(self.templates[t][1]))
                    spans.append((max(i - k - slack, 0), min(i - k + n + slack, len(words))))
        starts = [m.start() for m in places]
        for a, b in cue_spans(text):
            i, j = bisect_left(starts, a), bisect_left(starts, b)
            spans += [(k, min(k + most, j)) for k in range(i, j, most)]
        out: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if out and a < out[-1][1] and b - out[-1][0] <= 2 * most:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def scan(self, text: str) -> list[tuple[int, int, str | None, int, list[str], list[str]]]:
        """First and last line, licence or None, bytes saved, words missing and added of each block."""
        if not (self.pattern.search(text) or re.search(CUE, text)):
            return []
        places = list(_WORD.finditer(text))
        words, out, done = [m[0].lower() for m in places], [], 0
        waiting = [(a, b, True) for a, b in reversed(self.blocks(text, words, places))]
        while waiting:
            a, b, first = waiting.pop()
            a = max(a, done) if first else a  # what the block before has confirmed isn't seen again
            if a >= b:
                continue
            block = " ".join(words[a:b])
            ranked = self.rank(block)
            for _, t in ranked:
                found = self.confirm(t, words, a, b)
                if found:
                    i, j, lost, extra = found
                    out.append((text.count("\n", 0, places[i].start()), text.count("\n", 0, places[j - 1].end()), self.templates[t][0], self.saving(t, " ".join(words[i:j])), lost, extra))
                    waiting += [(c, d, False) for c, d in ((j, b), (a, i)) if c < d]
                    done = max(done, j)
                    break
            else:
                begin, end = places[a].start(), places[b - 1].end()
                if ranked and ranked[0][0] >= LIKELY * len(self.plain.compress(block.encode())) and re.search(CUE, text[begin:end]):
                    out.append((text.count("\n", 0, begin), text.count("\n", 0, end), None, ranked[0][0], *wording(self.templates[ranked[0][1]][1], words[a:b])))
        return sorted(out, key=lambda x: (x[0], x[2] or ""))

    def confirmed(self, text: str) -> list[tuple[int, int, str, int, list[str], list[str]]]:
        return [x for x in self.scan(text) if x[2]]


FOUND = pa.list_(pa.struct([("line", pa.int32()), ("license", pa.string()), ("saved", pa.int32()), ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string()))]))


def scan_batches(notices: dict[str, tuple[str, ...]]):
    def scan(batches):
        scanner = Scanner(notices)
        for batch in batches:
            rows = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                found = scanner.scan(text) if text else []
                rows.append([{"line": line, "license": name, "saved": saved, "missing": lost, "added": extra} for line, _, name, saved, lost, extra in found])
            yield pa.record_batch([*batch.columns[:-1], pa.array(rows, FOUND)], names=[*batch.schema.names[:-1], "blocks"])

    return scan


def scan_licenses(docs: DataFrame, notices: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, blocks (line, license or null, bytes saved, words missing and added; by line, those
    of a line by name), licenses (the confirmed ones, sorted). Of templates that save the same the first by name wins.

    saved counts bytes of the words joined by a space. Null and empty texts, and texts without a cue or a template's
    wording, have no blocks; very long texts are scanned whole; rows that repeat are scanned one by one; no rows give no
    rows. Only texts with a cue or an anchor leave the JVM. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.lower(text).alias("low"))
    rows = rows.select("doc_id", F.when(may_hold(F.col("low"), notices or NOTICES), F.col("text")).alias("text"))
    kind = "array<struct<line:int,license:string,saved:int,missing:array<string>,added:array<string>>>"
    out = rows.mapInArrow(scan_batches(notices or NOTICES), f"doc_id long, blocks {kind}")
    return out.withColumn("licenses", F.array_sort(F.array_distinct(F.array_compact(F.transform("blocks", lambda b: b["license"])))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(read_table(spark, sf_dir, "documents"))
    saved = F.aggregate("blocks", F.lit(0), lambda a, b: a + b["saved"])
    return out.select("doc_id", F.size("blocks").cast("long").alias("n_blocks"), F.array_join("licenses", ",").alias("licenses"), saved.cast("long").alias("bytes_saved"))

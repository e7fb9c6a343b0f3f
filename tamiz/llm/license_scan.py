"""License notices by conditional compression.

A candidate block is compressed alone and again with each license text as a raw zstandard dictionary. The text that saves most
describes the block best; it is confirmed, or not, by aligning its words with the block's and listing the exact differences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.llm.common import body, table, with_small_batches

# Public license notices, by identifier and form.
TEMPLATES: dict[str, str] = {
    "MIT notice": "Released under the MIT License.",
    "MIT notice (licensed)": "Licensed under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Every template holds one of these; text without them has no candidate block.
CUE = r"(?i)licen[sc]|copyright|redistribut|permission|public domain"
#: Words around a cue that belong to its block, and words of two cues that are still one block.
AROUND = 40
#: Share of a template's words that may be missing, added or replaced.
DIFFERENCES = 0.15
#: Templates that are aligned, best compression first, before a block counts as unconfirmed.
RANKED = 4

_OUT = "doc_id long, license string, begin_word long, end_word long, saved long, differences long, missing array<string>, added array<string>"


def _plain(text: str) -> list[str]:
    return re.findall(r"[\w.+-]*\w", text.lower())


@lru_cache(maxsize=1)
def _templates() -> list[tuple[str, list[str], zstandard.ZstdCompressor]]:
    out = []
    for name, text in TEMPLATES.items():
        words = _plain(text)
        known = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.append((name, words, zstandard.ZstdCompressor(level=9, dict_data=known, write_content_size=False, write_checksum=False)))
    return out


def blocks(words: list[str]) -> list[tuple[int, int]]:
    """Word ranges around the cues; near cues share one. A range is cut into overlapping pieces, so that each is short."""
    ranges: list[list[int]] = []
    for k, word in enumerate(words):
        cue = re.match(CUE, word) or re.search(CUE, word) or (word == "public" and words[k + 1:k + 2] == ["domain"])
        if cue:
            begin, end = max(0, k - AROUND), min(len(words), k + AROUND)
            if ranges and begin <= ranges[-1][1]:
                ranges[-1][1] = end
            else:
                ranges.append([begin, end])
    longest = max(len(w) for _, w, _ in _templates())
    pieces = []
    for begin, end in ranges:
        step = 2 * longest
        at = begin
        while True:
            pieces.append((at, min(end, at + step + longest)))
            if at + step + longest >= end:
                break
            at += step
    return pieces


def ranking(words: list[str]) -> list[tuple[int, int]]:
    """(bytes saved, template index), most first, for a block of words."""
    block = " ".join(words).encode()
    alone = len(zstandard.ZstdCompressor(level=9, write_content_size=False, write_checksum=False).compress(block))
    saved = [(alone - len(c.compress(block)), k) for k, (_, _, c) in enumerate(_templates())]
    return sorted(saved, key=lambda s: (-s[0], s[1]))


def differences(template: list[str], words: list[str]) -> tuple[int, int, list[str], list[str]] | None:
    """(begin, end, missing words, added words) of the place in ``words`` that reads most like the template."""
    matcher = SequenceMatcher(None, template, words, autojunk=False)
    longest = matcher.find_longest_match(0, len(template), 0, len(words))
    if not longest.size:
        return None
    slack = max(1, round(DIFFERENCES * len(template)))
    low = max(0, longest.b - longest.a - slack)
    high = min(len(words), longest.b + len(template) - longest.a + slack)
    part = words[low:high]
    same = [m for m in SequenceMatcher(None, template, part, autojunk=False).get_matching_blocks() if m.size]
    if not same:
        return None
    begin, end = same[0].b, same[-1].b + same[-1].size
    in_template = {k for m in same for k in range(m.a, m.a + m.size)}
    in_part = {k for m in same for k in range(m.b, m.b + m.size)}
    missing = [w for k, w in enumerate(template) if k not in in_template]
    added = [part[k] for k in range(begin, end) if k not in in_part]
    return low + begin, low + end, missing, added


def scan(text: str) -> list[tuple]:
    """(license, begin, end, saved, differences, missing, added) of each notice of a text, in order, without overlaps."""
    words = _plain(text)
    found: list[tuple] = []
    for begin, end in blocks(words):
        open_parts = [(begin, end)]
        while open_parts:
            low, high = open_parts.pop()
            confirmed = None
            ranked = [r for r in ranking(words[low:high]) if r[0] > 0]
            for place, (saved, k) in enumerate(ranked):
                if place >= RANKED and confirmed:
                    break
                name, template, _ = _templates()[k]
                best = differences(template, words[low:high])
                if best is None or max(len(best[2]), len(best[3])) > DIFFERENCES * len(template):
                    continue
                wrong = max(len(best[2]), len(best[3]))
                # Of the confirmed ones the longest text with the fewest differences names the notice.
                key = (len(template) - 2 * wrong, saved)
                if confirmed is None or key > confirmed[0]:
                    confirmed = (key, name, low + best[0], low + best[1], saved, wrong, best[2], best[3])
            if confirmed:
                found.append(confirmed[1:])
                open_parts += [(a, b) for a, b in ((low, confirmed[2]), (confirmed[3], high)) if b - a >= 3]
    chosen: list[tuple] = []
    for row in sorted(set(map(lambda r: (*r[:5], tuple(r[5]), tuple(r[6])), found)), key=lambda r: (r[1], -r[2])):
        if not chosen or row[1] >= chosen[-1][2]:
            chosen.append(row)
    return chosen


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "license", "begin_word", "end_word", "saved", "differences", "missing", "added"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            rows += [(doc_id, *row[:5], list(row[5]), list(row[6])) for row in scan(text)]
        columns = list(zip(*rows)) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per license notice of docs(doc_id, text): license, word range, bytes saved and the exact word differences.

    Words are lower-case runs of letters, digits, dots and hyphens; begin_word and end_word count them. Null, empty and
    unlicensed texts give no rows; repeated rows give repeated rows; empty table: no rows; other columns are ignored. A text
    is scanned by one task, in blocks around the cue words; only texts with a cue leave the JVM.
    """
    with_small_batches(docs.sparkSession)
    cued = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text")).where(F.col("text").rlike(CUE))
    return cued.mapInArrow(_scan, _OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.withColumns({"missing": F.array_join("missing", " "), "added": F.array_join("added", " ")})

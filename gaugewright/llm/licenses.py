"""License scan: base phrases, and templates with optional and replaceable regions compiled into token automata.

Template markup: ``[[ ... ]]`` encloses an optional region, ``{{a-b}}`` stands for a to b arbitrary words, ``((x|y))`` for one
of several wordings, and all other words are mandatory and must match exactly. A template is compiled into an automaton over
words, which is run from every place where a match can begin. A template without a mandatory word is refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: The mandatory wording of public license texts and of the notices that refer to them. ``[[...]]`` encloses
#: what may be left out, ``{{a-b}}`` what may be replaced by a to b words, ``((x|y))`` is one of several wordings.
_WARRANTY = (
    "this software is provided by the {{1-12}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness"
    " for a particular purpose are disclaimed in no event shall {{1-12}} be liable for any direct indirect incidental special exemplary or consequential damages including but"
    " not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in"
    " contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source"
    " code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright"
    " notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
)
_FREE = "{{1-6}} is free software you can redistribute it and or modify it under the terms of the gnu "
_LATER = " as published by the free software foundation either version {{1-2}} of the license or [[at your option]] any later version"
TEMPLATES = {
    "mit-notice": "[[this {{1-3}} is]] [[released]] [[licensed]] under the [[terms of the]] mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in the"
    " software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit"
    " persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]]"
    " shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not"
    " limited to the warranties of merchantability fitness for a particular purpose and ((noninfringement|non infringement)) in no event shall the {{1-12}} be liable for any claim"
    " damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and"
    " this permission notice appear in all copies the software is provided as is and {{1-12}} disclaims all warranties with regard to this software including all implied warranties"
    " of merchantability and fitness in no event shall {{1-12}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of"
    " use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd-2-clause": _BSD + _WARRANTY,
    "bsd-3-clause": _BSD + "[[and or]] [[3]] neither the name of {{1-12}} nor the names of its contributors may be used to endorse or promote products derived from this software without"
    " specific prior written permission " + _WARRANTY,
    "apache-2.0": "licensed under the apache license version 2 0 [[the license you may not use this file except in compliance with the license]]",
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license"
    " at {{1-12}} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of"
    " any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl-3.0": "[[this {{1-3}} is]] licensed under the gnu general public license version 3 [[or [[at your option]] any later version]]",
    "gpl-program": _FREE + "general public license as published by the free software foundation [[either]] version {{1-2}} [[of the license]] [[or at your option any later version]]",
    "lgpl-library": _FREE + "((lesser|library)) general public license" + _LATER,
    "agpl-program": _FREE + "affero general public license" + _LATER,
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at {{1-8}}",
    "cc-notice": "this work is licensed under a creative commons {{1-8}} license",
    "zlib-text": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"
    " permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following"
    " restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an"
    " acknowledgment in the product documentation would be appreciated but is not required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as"
    " being the original software [[3]] this notice may not be removed or altered from any source distribution",
    "unlicense-text": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in"
    " source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
}

_CLASSES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_CLASSES).split() if text else []


@dataclass
class Template:
    """Token automaton: ``steps[state]`` maps a word (None: any word) to a next state; ``free`` are moves without a word."""

    markup: str
    steps: list[dict] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        tokens = iter(re.findall(r"\[\[|\]\]|\(\(|\)\)|\||\{\{\d+-\d+\}\}|[^\s\[\]{}()|]+", self.markup))
        self.end = self._sequence(tokens, self._state())[0]
        self.begin = self._closure({0})
        self.first = {w for s in self.begin for w in self.steps[s] if w is not None}
        self.anywhere = any(None in self.steps[s] for s in self.begin)
        mandatory = self._mandatory()
        if not mandatory:
            raise ValueError(f"template without a mandatory word: {self.markup}")
        self.size, self.anchor = len(mandatory), max(mandatory, key=len)

    def _state(self) -> int:
        self.steps.append({})
        self.free.append([])
        return len(self.steps) - 1

    def _move(self, at: int, word: bytes | None) -> int:
        to = self._state()
        self.steps[at][word] = to
        return to

    def _sequence(self, tokens: Iterator[str], at: int) -> tuple[int, str]:
        """Append moves for the tokens up to a closing mark or bar -> (last state, that mark)."""
        for t in tokens:
            if t in ("]]", "))", "|"):
                return at, t
            if t == "[[":
                inner = self._state()
                self.free[at].append(inner)
                end = self._state()
                self.free[self._sequence(tokens, inner)[0]].append(end)
                self.free[at].append(end)
                at = end
            elif t == "((":
                end, mark = self._state(), "|"
                while mark == "|":
                    inner = self._state()
                    self.free[at].append(inner)
                    last, mark = self._sequence(tokens, inner)
                    self.free[last].append(end)
                at = end
            elif t.startswith("{{"):
                low, high = map(int, t[2:-2].split("-"))
                end = self._state()
                for k in range(high):
                    if k >= low:
                        self.free[at].append(end)
                    at = self._move(at, None)
                self.free[at].append(end)
                at = end
            else:
                at = self._move(at, t.encode())
        return at, ""

    def _mandatory(self) -> list[bytes]:
        flat = self.markup
        while "[[" in flat:
            flat = re.sub(r"\[\[[^\[\]]*\]\]", " ", flat)
        return [w.encode() for w in re.sub(r"\{\{.*?\}\}|\(\(.*?\)\)", " ", flat).split()]

    def _closure(self, states: set[int]) -> frozenset[int]:
        todo = list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in states:
                    states.add(x)
                    todo.append(x)
        return frozenset(states)

    def match(self, words: list[bytes], at: int) -> int:
        """End of the longest match that begins at word ``at``, or -1."""
        states, found = self.begin, -1
        for k in range(at, len(words) + 1):
            if self.end in states:
                found = k
            if k == len(words) or not states:
                break
            states = self._closure({x for s in states for w in (words[k], None) if (x := self.steps[s].get(w)) is not None})
        return found

    def find(self, words: list[bytes]) -> tuple[int, int] | None:
        """First place (start, end) where the template matches."""
        if self.anchor not in words:
            return None
        for k, w in enumerate(words):
            if (self.anywhere or w in self.first) and (end := self.match(words, k)) >= 0:
                return k, end
        return None


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches).

    One row per input row. ``matches`` lists label:start:end in words for accepted templates, each at its first place and
    as long as it matches. ``score`` is n / (n + 4) for the n mandatory words of the longest wording found, phrases
    included, and 0 without one: two words of a phrase are weak evidence, a whole license text is nearly certain. Null and
    empty texts have no words. Repeated rows are each scanned, a null doc_id is kept, other columns are ignored; texts are
    read whole, however long.
    """
    wanted = [(p.encode().split(), label) for p, label in phrases.items()]
    compiled = {label: Template(markup) for label, markup in templates.items()}
    lasts = {w[-1] for w, _ in wanted}
    sizes = {label: len(w) for w, label in wanted}

    def one(text: bytes | None) -> tuple:
        words = words_of(text)
        places, base = [], set()
        present = set(words)
        if present & lasts:
            for phrase, label in wanted:
                k = -1
                while True:
                    try:
                        k = words.index(phrase[-1], k + 1)
                    except ValueError:
                        break
                    start = k - len(phrase) + 1
                    if start >= 0 and words[start : k + 1] == phrase:
                        places.append(start)
                        base.add(label)
        found = {label: at for label, t in compiled.items() if t.anchor in present and (at := t.find(words))}
        return (
            len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found.keys())),
            (n := max([compiled[label].size for label in found] + [sizes[label] for label in base], default=0)) / (n + 4), ",".join(f"{label}:{a}:{b}" for label, (a, b) in sorted(found.items())),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*map(one, batch.column(1).to_pylist()), strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"],
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches string"
    return docs.select("doc_id", F.col("text").cast("binary").alias("body")).mapInArrow(run, schema)

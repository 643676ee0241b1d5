"""Licence scans: a paragraph classifier (sparse word n-gram logistic regression) names the licence family, below a
calibrated probability a paragraph is of an unknown licence, and a comparison with the family's templates confirms it.

Paragraphs: comment marks at the start of lines are dropped; a paragraph ends at a blank line, or at a line that ends with
a sentence or clause (`.`, `!`, `?`, `:`, `;`). So lines that were broken to fit are read together.

Classifier: softmax regression over all words of a paragraph and all pairs of known words in a row, by their CRC-32; its classes are the
families below, `unknown` (licences outside them) and `none`. The driver fits it on the labelled paragraphs below, seeded variations
of them (bounded: `VARIATIONS` of each), and names of licences in short notices. Temperature, least probability and least share of a template
are chosen with a model that was fitted without a third of each class's paragraphs and names, on those and on `HELD_OUT`. Every paragraph is classified: there is no search for cues
before it.

Notices of several licences: the parts of a licence's paragraph between "and", "or" and the like are classified too, and each whose
class is confirmed by one of that family's short names adds the family (`also`).

All of it is one projection of the documents: n-grams look their weights up in arrays that are constants of the plan (a fixed
vocabulary). Nothing is shuffled, so no hot paragraph or document gathers anywhere.

Defined cases: null and empty texts have no paragraphs; each row gets its result, so do repeated ones; a paragraph that
occurs more than once in a document counts each time; texts and paragraphs of any length are read whole; of equally likely
families the first in the list below is named; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import random
import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VARIATIONS = 24
NONE, UNKNOWN = "none", "unknown"

#: Labelled paragraphs: well-known notices and texts of each family, whole.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "You may obtain a copy of the License at",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to you under the Apache License, Version 2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "Licensed under Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        "This project is licensed under the MIT license.",
        "The MIT License (MIT)",
        "SPDX-License-Identifier: MIT",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Distributed under the 3-clause BSD License.",
        "Released under the new BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "Released under GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "creative_commons_noncommercial": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "Available under a CC BY-NC-SA 4.0 licence.",
    ),
    "creative_commons": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
        "Licensed under CC BY-SA 3.0.",
    ),
    "public_domain": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "The author waives all rights to this work; it is in the public domain.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright 2020 Example Corporation. All rights reserved.",
        "No part of this publication may be reproduced or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This document is confidential and proprietary; unauthorized copying is prohibited.",
        "This software is the confidential and proprietary information of the company and may be used only under the terms of its license agreement.",
    ),
}
#: Notices of licences outside the families: the class `unknown`.
OUTSIDE = (
    "Licensed under the Eclipse Public License, version 2.0.", "Licensed under the zlib licence.", "Released under the Artistic License.", "Distributed under the Boost Software License, Version 1.0.", "This package is licensed under the terms of the WTFPL.", "Licensed under the Shared Data Licence, third edition.",
    "Use of this dataset is governed by the data licence of the agency.", "Available under the Open Government Licence v3.0.", "This file is licensed under a custom licence; see the file of that name.", "Released under the Community License Agreement.", "Licensed under the Open Database License.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution.", "SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: EPL-2.0", "Permission to use this font is granted under the SIL Open Font License.",
    "Permission to use, copy, modify, and distribute this data set is granted to members of the consortium, under the terms of its agreement.", "The model is released under the Research License; use for weapons is not allowed.",
)
#: Notices of licences that no labelled paragraph names, for the choice of the cutoffs alone.
HELD_OUT = (
    "Licensed under the European Union Public Licence, version 1.2.", "SPDX-License-Identifier: CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License.", "Licensed under the Microsoft Public License.", "Released under the Academic Free License version 3.0.",
    "This software is licensed under the Business Source License 1.1.", "Distributed under the Python Software Foundation License Version 2.", "Licensed under the Elastic License 2.0.", "Licensed under the Server Side Public License.", "SPDX-License-Identifier: OSL-3.0", "Released under the PostgreSQL Licence.", "Licensed under the Open Data Commons Attribution License.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
)
#: Paragraphs with words of licences that are none.
OTHER = (
    "He lost his driving license last year and had to take the test again.", "The bank granted a license to the new branch.", "A fishing license costs ten dollars and is valid for one year.", "They asked for permission to enter the public building.",
    "The version of the story that was published later had two conditions.", "The software was distributed on a disk with the book.", "Free entry for all members of the general public.", "You may obtain a copy of the report at the desk.",
    "Human rights are reserved for nobody; they belong to all people.", "The warranty of the machine covers parts for two years.", "The law requires a written notice from the owner.", "Mozilla and Apache are names of projects.", "The domain of the function is the set of all numbers.",
    "Public transport is free of charge on that day.", "The author modified the source of the river on the map.", "A creative person works in the commons of the university.", "The program was modified and published again in this form.", "Copyright law is taught at this school.", "The foundation gave free food to any person.",
    "The city issued a new licence to the restaurant, and the owner has to renew it in March.", "All seats are reserved; please show the ticket to the person at the door.", "The compiler reads the source code and writes a binary file.", "We use the library to parse files and distribute the work over many machines.",
)
#: Short names of the families' licences, and of licences outside them.
SHORT = {
    "apache": ("Apache 2.0", "Apache-2.0", "Apache License 2.0", "Apache License, Version 2.0", "Apache License", "Apache Software License", "Apache v2", "ASL 2.0"),
    "mit": ("MIT", "MIT License", "Expat License", "MIT/X11", "X11 License"),
    "bsd": ("BSD", "BSD-3-Clause", "BSD-2-Clause", "BSD License", "New BSD License", "3-clause BSD", "2-clause BSD", "Simplified BSD License", "Modified BSD License"),
    "gpl": ("GPL", "GPLv3", "GPLv2", "GPL-3.0", "GPL-2.0", "GPL v3", "GPL 2", "GPL 3", "GNU GPL", "GNU GPLv3", "GNU GPLv2", "GPLv2 or later", "GPLv3 or later", "GNU General Public License", "GNU General Public License v3.0", "General Public License"),
    "lgpl": ("LGPL", "LGPLv3", "LGPLv2.1", "LGPL-2.1", "LGPL-3.0", "GNU LGPL", "GNU Lesser General Public License", "Lesser GPL"),
    "mpl": ("MPL", "MPL 2.0", "MPL-2.0", "MPLv2", "Mozilla Public License", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0"),
    "creative_commons_noncommercial": ("CC BY-NC", "CC BY-NC 4.0", "CC-BY-NC-SA-4.0", "CC BY-NC-SA", "CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial", "Creative Commons BY-NC"),
    "creative_commons": ("CC BY", "CC BY 4.0", "CC-BY-SA-4.0", "CC BY-SA", "CC BY-SA 3.0", "CC BY-ND 4.0", "Creative Commons Attribution", "Creative Commons Attribution-ShareAlike", "Creative Commons BY"),
    "public_domain": ("CC0", "CC0 1.0", "CC0-1.0", "Creative Commons Zero", "Creative Commons CC0", "Unlicense", "The Unlicense", "public domain"),
    "unknown": ("AGPL", "AGPLv3", "AGPL-3.0", "GNU Affero General Public License", "EPL 2.0", "EPL-1.0", "zlib", "WTFPL", "BSL 1.0", "SIL OFL 1.1", "ODbL", "Artistic 2.0", "Eclipse Public License", "Boost Software License", "Open Government Licence", "OpenRAIL", "ISC", "ISC License"),
}
#: Notices that name a licence; {} is its name.
FRAMES = (
    "Licensed under {}", "Licensed under the {}.", "This project is licensed under the {}.", "This program is licensed under {}.", "The code is released under {}", "Released under the {}.", "License: {}", "Distributed under {}.", "Distributed under the terms of the {}", "Available under {}.",
    "SPDX-License-Identifier: {}", "Publié sous {}.", "Sous licence {}", "Lizenziert unter {}", "Publicado bajo {}.", "under a {} licence", "covered by the {} license", "It may be used under the {}, see the file for details", "Dual-licensed under {} and {}.", "Licensed under either of {} or {}", "{} or {}", "either {} or {} at your option",
)
#: Words that prose is full of: the filler of made paragraphs without a licence.
PLAIN = "the of and to in a is for or any this that by be with as it on not you may at are from an if was were he she they we his her their our has had have will would can could one two first last year day time way people man woman house city water long great small old new made went came said saw took many some more most other than then there here when where who which what how but so all no up out into over after before under between about again still never always often very much little good".split()
#: Frequent words of other languages (German "mit" is no licence).
FOREIGN = "der die das und ist mit von zu den dem ein eine nicht auf auch als an es im sich aus bei nach wird sind le la les des et est un une que qui dans pour par sur pas plus avec ne se ce el los las en y por con para una su al lo como il di che non per sono da del della o os um uma com mais het een op te voor".split()
_TOKEN = r"[a-z0-9]+"
#: Marks of comments, lists and quotes at the start of a line.
MARKS = r"(?m)^[ \t]*(?:(?:/\*+|\*+/?|//+|#+|--+|;+|%+|<!--|>+|\.\.|(?:dnl|REM|rem)(?=[ \t])|\"{3}|'{3})[ \t]*)+"
#: Where a paragraph ends.
BREAK = r"(?<=[.!?:;][\")\]]{0,1})[ \t\r]*\n\s*|\n[ \t\r]*\n\s*"
#: What a licence is called: up to five words before "license", from the last plain one on.
NAMED = rf"((?:(?!(?:{'|'.join([*PLAIN, 'see', 'released', 'licensed', 'distributed', 'available', 'per', 'via', 'its'])})(?![a-z0-9]))[a-z][a-z0-9]* ){{1,5}})licen[cs]e(?![a-z0-9])"
#: Where a notice of several licences is cut.
CUT = r"(?i)(?<![a-z0-9])(?:and|or|either|both|und|oder|et|ou|y|o)(?![a-z0-9])|[/|+&]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)


def words_of(text: str) -> list[str]:
    return re.findall(_TOKEN, text.translate(_FOLD))


def code(*words: str) -> int:
    return zlib.crc32(" ".join(words).encode())


def grams(words: list[str]) -> set[int]:
    """Words and pairs in a row."""
    return {code(w) for w in words} | {code(*p) for p in zip(words, words[1:], strict=False)}


def triples(words: list[str]) -> set[int]:
    """Three words in a row; of a shorter text all its words."""
    return {code(*words[k : k + 3]) for k in range(max(1, len(words) - 2))} if words else set()


def name_words(words: list[str]) -> set[str]:
    """Words of the names of licences in a text."""
    return {w for name in re.findall(r"(?<![a-z0-9])" + NAMED, " ".join(words)) for w in name.split()}


def labelled(variations: int = VARIATIONS, seed: int = 5, part: int | None = None, of: bool = False) -> list[tuple[str, str]]:
    """(paragraph, family): the labelled paragraphs, each with words added before and after, some left out, or a part of it; names in short
    notices; and prose. With `part`, every third paragraph and name of a class from that one on is left out (`of`: they alone are taken)."""
    r = random.Random(seed)
    extra = ["2019", "2024", "Jane Doe", "Example Inc", "the authors", "contributors", "project", "code", "see", "for details", "theon ered", "lara den"]
    filler = lambda n: [r.choice(PLAIN) for _ in range(n)]
    mine = lambda texts: [t for k, t in enumerate(texts) if part is None or (k % 3 == part) == of]
    out = []
    for family, texts in [*TEMPLATES.items(), (UNKNOWN, OUTSIDE), (NONE, OTHER)]:
        for t in mine(texts):
            out.append((t, family))
            for _ in range(variations):
                w = t.split()
                if len(w) > 9 and r.random() < 0.6:
                    for _ in range(r.randint(1, 2)):
                        del w[r.randrange(len(w))]
                if len(w) > 12 and r.random() < 0.5:
                    k = r.randrange(len(w) - 9)
                    w = w[k : k + r.randint(9, 30)]
                out.append((" ".join(r.sample(extra, r.randint(0, 2)) + w + r.sample(extra, r.randint(0, 2))), family))
    named = [(n, f) for f, names in SHORT.items() for n in mine(names)]
    for name, family in named:
        if len(words_of(name)) > 1:
            out += [(name, family)] * 2
        for frame in FRAMES if variations >= VARIATIONS else r.sample(FRAMES, 6):
            second = r.choice(named)[0]
            a, b = (name, second) if r.random() < 0.5 else (second, name)
            out.append((frame.format(a, b) if frame.count("{}") == 2 else frame.format(name), family))
        for _ in range(2):  # prose that names it
            out.append((" ".join([*filler(r.randint(3, 12)), name, *filler(r.randint(3, 12))]), NONE))
    made = lambda: "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(r.randint(2, 4)))
    for _ in range(6 * len(named)):  # texts of unknown words, numbers and a few plain words
        out.append((" ".join(r.choice([made, made, lambda: str(r.randint(0, 12)), lambda: r.choice(PLAIN)])() for _ in range(r.randint(1, 12))), NONE))
        share = r.random()
        out.append((" ".join("mit" if (x := r.random()) < 0.06 else r.choice(FOREIGN) if x < share else made() for _ in range(r.randint(3, 40))), NONE))
    for _ in range(len(named)):  # licences that nobody has heard of
        out.append((r.choice(FRAMES[:18]).format(f"{made().capitalize()} {r.choice(['Licence', 'License', 'Public License', 'License 2.0', 'Open License, version 3', 'Shared Licence'])}"), UNKNOWN))
    # words of notices within prose are none, alone or a few of them
    words = sorted({w for texts in (*TEMPLATES.values(), OUTSIDE) for t in texts for w in words_of(t)} - set(PLAIN))
    for w in words:
        out += [(" ".join([*filler(r.randint(3, 20)), w, *filler(r.randint(3, 20))]), NONE) for _ in range(2)]
        out += [(" ".join(x for v in [w, *r.sample(words, r.randint(1, 4))] for x in [*filler(r.randint(1, 4)), v]), NONE)]
    return out


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Model:
    """Softmax regression over n-grams; `temperature` divides the scores; `least` and `share` are what a named family needs.

    A code's place in the vocabulary is found by its remainders: `tables` holds, for a few moduli, the code and its place at each remainder; codes
    that meet another one go to the next table, until none is left.
    """

    MODULI = (16381, 4093, 1021, 1019, 1013, 1009)

    def __init__(self, rounds: int = 120, rate: float = 0.5, decay: float = 1e-3):
        self.families = [*TEMPLATES, UNKNOWN, NONE]
        texts = [t for texts in (*TEMPLATES.values(), OUTSIDE, OTHER, [" ".join(PLAIN), " ".join(FOREIGN)]) for t in texts]
        texts += [f.format(*[n] * f.count("{}")) for names in SHORT.values() for n in names for f in FRAMES]
        self.codes = sorted(set().union(*(grams(words_of(t)) for t in texts)))
        self.place = {c: k for k, c in enumerate(self.codes)}
        self.tables, left = [], self.codes
        for m in self.MODULI:
            held, after = [-1] * m, []
            for c in left:
                if held[c % m] < 0:
                    held[c % m] = c
                else:
                    after.append(c)
            self.tables.append((m, held, [self.place.get(c, -1) for c in held]))
            if not (left := after):
                break
        else:
            raise ValueError("n-grams without a place")
        self.names = [sorted(set().union(*(name_words(words_of(t)) for t in TEMPLATES.get(f, ())), *(name_words([*words_of(n), "license"]) for n in SHORT.get(f, ()) if f != UNKNOWN))) for f in self.families]
        self.chosen(0, rounds, rate, decay)
        self.w, self.b = self.fit(labelled(), rounds, rate, decay)
        self.compare_with(None)

    def chosen(self, part: int, rounds: int, rate: float, decay: float) -> None:
        """Temperature and cutoffs, by a model that has seen none of the texts that they are chosen on."""
        self.w, self.b = self.fit(labelled(part=part), rounds, rate, decay)
        self.compare_with(part)
        held = labelled(variations=8, seed=6, part=part, of=True) + [(t, UNKNOWN) for t in HELD_OUT for _ in range(8)]
        scores, y = self.scores([t for t, _ in held]), np.array([self.families.index(f) for _, f in held])
        loss = lambda t: -np.log(softmax(scores / t)[np.arange(len(y)), y] + 1e-12).mean()
        self.temperature = min((0.5, 0.7, 1.0, 1.5, 2.0, 3.0, 4.0), key=loss)
        found = [self.guess(t) for t, _ in held]
        wrong_name = 3  # naming a wrong family is as bad as so many notices left unknown
        gain = lambda got, f: 1 if got == f else -wrong_name if got not in (UNKNOWN, NONE) else 0
        right = lambda least, share: sum(gain(self.decide(*g, least, share), f) for g, (_, f) in zip(found, held, strict=True))
        self.least, self.share = max(((a, s) for a in (0.3, 0.4, 0.5, 0.6, 0.7, 0.8) for s in (0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)), key=lambda c: right(*c))

    def compare_with(self, without: int | None) -> None:
        """The texts and names that a family is confirmed by."""
        some = lambda texts: [t for k, t in enumerate(texts) if without is None or k % 3 != without]
        self.short = [[triples(words_of(t)) for t in some(SHORT.get(f, ()))] if f != UNKNOWN else [] for f in self.families]
        self.templates = [[triples(words_of(t)) for t in some(TEMPLATES.get(f, ()))] + s for f, s in zip(self.families, self.short, strict=True)]

    def fit(self, data: list[tuple[str, str]], rounds: int, rate: float, decay: float) -> tuple[np.ndarray, np.ndarray]:
        x, y = self._matrix([t for t, _ in data]), np.array([self.families.index(f) for _, f in data])
        w, b = np.zeros((len(self.codes), len(self.families)), np.float32), np.zeros(len(self.families), np.float32)
        sums, each = [np.full_like(v, 1e-8) for v in (w, b)], (1 / np.bincount(y)[y]).astype(np.float32)
        eye = np.eye(len(self.families), dtype=np.float32)
        for _ in range(rounds):
            d = (eye[y] - softmax(x @ w + b)) * each[:, None]
            for v, g, s in ((w, x.T @ d - decay * w, sums[0]), (b, d.sum(0), sums[1])):
                s += g * g
                v += rate * g / np.sqrt(s)
        return np.round(w.astype(np.float64), 4), np.round(b.astype(np.float64), 4)

    def _places(self, words: list[str]) -> list[int]:
        known = [code(w) in self.place for w in words]
        pairs = [code(a, b) for a, b, x, y in zip(words, words[1:], known, known[1:], strict=False) if x and y]
        return sorted({self.place[c] for c in [*map(code, words), *pairs] if c in self.place})

    def _matrix(self, texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.codes)), np.float32)
        for k, t in enumerate(texts):
            x[k, self._places(words_of(t))] = 1
        return x

    def scores(self, texts: list[str]) -> np.ndarray:
        return self._matrix(texts) @ self.w + self.b

    def guess(self, text: str, by_name: bool = False) -> tuple[int, float, float]:
        """Place of the likeliest class, its probability, and the share of a template of it: the larger of both containments,
        at its best template (`by_name`: whether a short name of it is there); 0 if a licence is named in words that the family's names don't have."""
        words = words_of(text)
        p = softmax(self.scores([text]) / self.temperature)[0]
        k, mine, every = int(p.argmax()), triples(words), triples(words) | grams(words)
        if not name_words(words) <= set(self.names[k]):
            return k, float(p[k]), 0.0
        if by_name:
            return k, float(p[k]), float(any(t <= every for t in self.short[k]))
        return k, float(p[k]), max((max(len(every & t) / len(t), len(mine & t) / max(len(mine), 1)) for t in self.templates[k]), default=0.0)

    def decide(self, k: int, probability: float, share: float, least: float, enough: float) -> str:
        name = self.families[k]
        return name if name == NONE or probability >= least and share >= enough else UNKNOWN

    def parts(self, text: str) -> list[str]:
        """The families that the parts of a notice name, sorted."""
        parts = [f"licensed under {t}" for t in re.split(CUT, text)]
        found = [self.decide(*self.guess(t, True), self.least, 1.0) for t in parts] if len(parts) > 1 else []
        return sorted(set(found) - {NONE, UNKNOWN})


_model: list[Model] = []


def model() -> Model:
    """The fitted model; fitted once in a process."""
    if not _model:
        _model.append(Model())
    return _model[0]


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text that have a letter or digit."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), MARKS, "")
    return F.filter(F.split(plain, BREAK), lambda x: x.rlike(r"[\p{L}\p{Nd}]"))


def _constant(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def classify(paragraph: Column, fitted: Model, by_name: bool = False) -> Column:
    """A struct (family, probability, template_share) of a paragraph; `by_name`: confirmed by short names alone."""
    tables = [(m, _constant(held, "array<bigint>"), _constant(places, "array<int>")) for m, held, places in fitted.tables]
    weights = _constant(fitted.w.tolist(), "array<array<double>>")
    templates = _constant([[sorted(t) for t in f] for f in (fitted.short if by_name else fitted.templates)], "array<array<array<bigint>>>")
    names = _constant(fitted.names, "array<array<string>>")
    tokens = F.regexp_extract_all(F.translate(paragraph, _UPPER, _LOWER), F.lit(f"({_TOKEN})"))
    rest = lambda t, k: F.slice(t, k, F.greatest(F.size(t), F.lit(1)))
    known = lambda a: F.filter(a, lambda x: x.isNotNull())
    enough = 1.0 if by_name else float(fitted.share)

    def place(c: Column) -> Column:
        m, held, _ = tables[0]
        at = F.when(F.get(held, (c % m).cast("int")) < 0, F.lit(None).cast("int"))  # codes of later tables met one here
        for m, held, places in tables:
            spot = (c % m).cast("int")
            at = at.when(F.get(held, spot) == c, F.get(places, spot))
        return at

    def looked(t: Column) -> Column:
        return F.transform(t, lambda w: F.struct(w.alias("w"), place(F.crc32(w)).alias("p")))

    def scored(t: Column) -> Column:
        pairs = F.zip_with(t, rest(t, 2), lambda a, b: F.when(a["p"].isNotNull() & b["p"].isNotNull(), place(F.crc32(F.concat(a["w"], F.lit(" "), b["w"])))))
        places = F.array_sort(F.array_distinct(known(F.concat(F.transform(t, lambda x: x["p"]), pairs))))
        start = F.array(*[F.lit(float(b)) for b in fitted.b])
        total = F.aggregate(places, start, lambda s, p: F.zip_with(s, F.get(weights, p), lambda x, y: x + y))
        return F.struct(F.transform(total, lambda x: x / float(fitted.temperature)).alias("s"), F.transform(t, lambda x: x["w"]).alias("t"))

    def likely(x: Column) -> Column:
        k = F.array_position(x["s"], F.array_max(x["s"])).cast("int") - 1
        e = F.aggregate(F.transform(x["s"], lambda v: F.exp(v - F.array_max(x["s"]))), F.lit(0.0), lambda a, v: a + v)
        return F.struct(k.alias("k"), (1.0 / e).alias("p"), F.when(k != fitted.families.index(NONE), x["t"]).alias("t"))

    def sets(x: Column) -> Column:
        t = x["t"]
        pairs = F.zip_with(t, rest(t, 2), lambda a, b: F.concat(a, F.lit(" "), b))
        three = known(F.zip_with(pairs, rest(t, 3), lambda a, b: F.concat(a, F.lit(" "), b)))
        three = F.when(F.size(t) > 2, three).otherwise(F.filter(F.array(F.concat_ws(" ", t)), lambda w: w != ""))
        code_of = lambda a: F.array_distinct(F.transform(a, F.crc32))
        named = F.flatten(F.transform(F.regexp_extract_all(F.concat_ws(" ", t), F.lit(r"(?<![a-z0-9])" + NAMED), F.lit(1)), lambda w: F.split(F.trim(w), " ")))
        return F.struct(x["k"].alias("k"), x["p"].alias("p"), code_of(three).alias("three"), code_of(F.concat(t, known(pairs), three)).alias("every"), (F.size(F.array_except(named, F.get(names, x["k"]))) == 0).alias("ours"))

    def judged(x: Column) -> Column:
        both = lambda a, t: F.size(F.array_intersect(a, t))
        share = lambda t: both(x["every"], t) / F.size(t) if by_name else F.greatest(both(x["every"], t) / F.size(t), both(x["three"], t) / F.greatest(F.size(x["three"]), F.lit(1)))
        best = F.when(x["ours"], F.coalesce(F.array_max(F.transform(F.get(templates, x["k"]), share)), F.lit(0.0))).otherwise(0.0)
        return F.struct(x["k"].alias("k"), x["p"].alias("p"), (F.floor(best).cast("double") if by_name else best).alias("share"))

    def named(x: Column) -> Column:
        sure = (x["p"] >= fitted.least) & (x["share"] >= enough)
        return F.struct(F.when(sure, F.get(F.array(*[F.lit(f) for f in fitted.families]), x["k"])).otherwise(UNKNOWN).alias("family"), x["p"].alias("probability"), x["share"].alias("template_share"))

    # one step at a time over an array of one, so that each value is computed once; a paragraph of no licence ends at the second
    one = F.filter(F.transform(F.transform(F.transform(F.array(tokens), looked), scored), likely), lambda x: x["t"].isNotNull())
    return F.get(F.transform(F.transform(F.transform(one, sets), judged), named), F.lit(0))


def scan(docs: DataFrame, fitted: Model | None = None) -> DataFrame:
    """Per row: doc_id, n_paragraphs (with a letter or digit), n_licence, families (sorted, comma-joined), n_unknown (paragraphs without a family), and
    `found`, the paragraphs of licences with their family, probability and template_share, and the families that parts of them name (`also`)."""
    fitted = fitted or model()

    def also(x: Column) -> Column:
        parts = F.split(x, CUT)
        named = F.transform(parts, lambda t: classify(F.concat(F.lit("licensed under "), t), fitted, by_name=True)["family"])
        return F.when(F.size(parts) > 1, F.array_sort(F.array_distinct(F.filter(named, lambda f: f.isNotNull() & (f != UNKNOWN))))).otherwise(F.array().cast("array<string>"))

    d = docs.select("doc_id", paragraphs(F.col("text")).alias("all"))
    found = F.transform("all", lambda x: F.struct(x.alias("paragraph"), classify(x, fitted).alias("c")))
    found = F.transform(F.filter(found, lambda x: x["c"].isNotNull()), lambda x: F.struct(x["paragraph"].alias("paragraph"), x["c"]["family"].alias("family"), x["c"]["probability"].alias("probability"), x["c"]["template_share"].alias("template_share"), also(x["paragraph"]).alias("also")))
    d = d.select("doc_id", F.size("all").cast("long").alias("n_paragraphs"), found.alias("found"))
    families = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform("found", lambda x: F.concat(F.array(x["family"]), x["also"]))), lambda f: f != UNKNOWN)))
    unknown = F.size(F.filter("found", lambda x: (x["family"] == UNKNOWN) & (F.size(x["also"]) == 0)))
    return d.select("doc_id", "n_paragraphs", F.size("found").cast("long").alias("n_licence"), F.concat_ws(",", families).alias("families"), unknown.cast("long").alias("n_unknown"), "found")

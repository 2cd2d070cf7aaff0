"""Licence notices on labelled sentences: plain forms, false friends, and the SQL twin on the same rows."""

import duckdb
import pandas as pd

from linetrace.llm import license_scan, oracles

NOTICES = {
    "MIT": [
        "This project is under the MIT license.",
        "License: MIT",
        "Licence: MIT",
        "See the LICENSE file. MIT License.",
        "MIT License",
        "The MIT License (MIT)",
        "Released under MIT.",
        "Released under MIT, see LICENSE.",
        "The code is MIT-licensed.",
        "All of it is MIT licensed, have fun.",
        '{"name": "x", "license": "MIT", "version": "1"}',
        "license = 'MIT'",
        "You can use it under the terms of the MIT licence.",
        "Distributed under the terms of the MIT License; see the file.",
        "This library is made available under an MIT license.",
        "The source code is governed by the MIT License.",
        "This package is covered by the MIT License.",
        "The licence is MIT.",
        "Its contents are subject to the MIT license.",
        "Author: A. B. Person\nLicense: MIT\nVersion: 2",
        "Relicensed under the Expat License in May.",
    ],
    "Apache-2.0": [
        "License: Apache-2.0",
        "Apache License, Version 2.0",
        "This work is licensed under the Apache License 2.0.",
        "The tool is published under the Apache 2.0 license.",
        "It comes under version 2.0 of the Apache License.",
        "Everything here is Apache 2.0 licensed.",
        "Licensed under Apache License v2.0 by its authors.",
        "The files are offered under the terms and conditions of the Apache License, Version 2.0!",
        "Is it free? The software is under the Apache Software License, Version 2.0.",
    ],
    "GPL-2.0": [
        "GNU General Public License, either version 2 or later",
        "Redistribute it under the GNU General Public License, version 2 or later.",
        "It is released under version 2 of the GNU General Public License.",
        "It is released under version 2 or later of the GNU General Public License.",
        "License: GPLv2",
        "The driver is distributed under the GPL v2.",
        "Modify it under the terms of the GNU GPL, version 2.",
    ],
    "GPL-3.0": [
        "The program is licensed under the GNU GPL v3.",
        "License: GPL-3.0",
        "Available under the GPLv3 or any later version.",
        "GNU General Public License v3.0",
        "The game is shared under the terms of the GNU General Public License, version 3.",
        "Licensed under the GPL, version 3 or newer.",
    ],
    "LGPL-2.1": ["This code is under the LGPL v2.1.", "Covered by the GNU Lesser General Public License, version 2.1.", "License: LGPL-2.1"],
    "AGPL-3.0": ["The server is released under the AGPL v3.", "Licensed under the GNU Affero General Public License, version 3."],
    "BSD-3-Clause": ["Use is governed by a BSD 3-Clause License.", "This project is under the New BSD License.", "License: BSD-3-Clause", "The 3-Clause BSD License"],
    "BSD-2-Clause": ["Released under the Simplified BSD License.", "The code is BSD 2-clause licensed."],
    "MPL-2.0": ["Subject to the terms of the Mozilla Public License, v. 2.0.", "The plug-in is available under the MPL 2.0."],
    "CC-BY-4.0": ["This data is under CC BY 4.0.", "Text shared under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Photos are made available under the CC BY-SA 4.0 licence.", "License: CC BY-SA 4.0"],
    "CC0-1.0": ["The maps are published under CC0.", "License: CC0 1.0 Universal"],
    "ISC": ["Released under the ISC license.", "ISC License"],
    "EPL-2.0": ["Made available under the Eclipse Public License 2.0."],
    "EUPL-1.2": ["Licensed under the European Union Public Licence, version 1.2."],
    "Unlicense": ["This script is under the Unlicense."],
    "Zlib": ["Distributed under the zlib License."],
    "Apache-2.0,MIT": [
        "Dual licensed under the MIT license or the Apache License, Version 2.0",
        "Licensed under either of Apache License, Version 2.0 or MIT license at your option.",
        "License: MIT OR Apache-2.0",
        "Released under the MIT and Apache 2.0 licenses.",
    ],
    "GPL-2.0,MIT": ["Dual licensed under the MIT or GPL version 2 licenses."],
    "BSD-3-Clause,GPL-2.0,MIT": ["Licensed under MIT, or BSD.\nIt is under the GPL v2 or the BSD 3-Clause License."],
}
NONE = [
    "This book was published by MIT Press in 1999.",
    "The data was provided by MIT researchers.",
    "It is not released under the MIT license.",
    "The model was released by MIT.",
    "The report was issued by MIT, and read by few.",
    "She studied at MIT. He did not.",
    "Where did they meet? MIT.",
    "It is shared by MIT and Harvard.",
    "The lab is available under MIT supervision.",
    "The work ran under MIT grant rules.",
    "The course is provided by the MIT Media Lab.",
    "The BSD daemon is red.",
    "BSD systems are provided by volunteers.",
    "The ISC conference opens on Monday.",
    "The talk was given at ISC, under a tent.",
    "Apache helicopters flew under 2.0 km.",
    "The Apache people lived here under their own law.",
    "This software is no longer under the GPL v2.",
    "The library isn't under the GPL v3.",
    "The library isn't MIT licensed.",
    "It was previously licensed under the Apache License, Version 2.0.",
    "The tool was never released under the MIT license.",
    "We keep non-MIT-licensed parts elsewhere.",
    "The license is not MIT.",
    "Nothing has been licensed yet.",
    "A fishing license is issued by the state.",
    "Her driving licence: none",
    "License: see below",
    "License: proprietary",
    "The licence of the pub was withdrawn.",
    "All rights reserved.",
    "He works under pressure.",
    "The mozilla foundation provides a browser.",
    "The Eclipse was visible under clear skies.",
    "He wrote on public licences in general.",
    "The boost came under way.",
    "Permit under section 2 of the general act.",
    "They were released under bail conditions.",
    "Which license should I choose?",
    "The MIT license is short; we compare it with others.",
    "People often ask what the Apache License, Version 2.0 means.",
    "The work is licensed. Under the MIT License it is not.",
    "gnu and gnat live under the tree.",
    "The Python snake is governed by instinct.",
    "The committee is subject to MIT rules.",
    "MIT",
    "mit",
    "Er kam mit, und sie auch.",
    "Lizenz: mit Auflagen",
]


def rows():
    return [*((text, said) for said, texts in NOTICES.items() for text in texts), *((text, "") for text in NONE)]


def test_notices_and_false_friends(spark):
    cases = rows()
    assert len(cases) >= 110
    docs = [(i, text) for i, (text, _) in enumerate(cases)] + [(-1, None), (-2, ""), (0, cases[0][0])]
    found = license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {r.doc_id: ",".join(r.licenses) for r in found}
    assert len(found) == len(docs) and got.pop(-1) == got.pop(-2) == ""
    wrong = [(text, said, got[i]) for i, (text, said) in enumerate(cases) if got[i] != said]
    assert not wrong, wrong
    documents = pd.DataFrame(docs, columns=["doc_id", "text"])  # read by the twin
    twin = duckdb.sql(oracles.OP2).fetchall()
    assert len(documents) == len(twin)
    assert sorted(twin) == sorted((r.doc_id, ",".join(r.licenses), r.n_sentences, ",".join(r.sentence_ids)) for r in found)


def test_a_long_list_of_names(spark):
    texts = ["MIT License or " * 30_000 + "ISC License.", "not under the " * 30_000 + "MIT License", "License: " * 30_000]
    got = {r.doc_id: list(r.licenses) for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: ["ISC", "MIT"], 1: [], 2: []}

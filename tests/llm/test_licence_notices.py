"""Every licence rule on the notice its licence publishes, plain and as comments, and on each way the cut could break it."""

import duckdb
import pytest

from thermocline.llm import licenses
from thermocline.llm.queries import SQL
from tools.compare import same

APACHE = """Copyright 2020 Somebody

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""

MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""

GPL3 = """Copyright (C) 2020  Somebody

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""

GPL2 = GPL3.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")

BSD2 = """Copyright (c) 2020, Somebody

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""

BSD3 = BSD2 + """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""

END = """

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"."""

MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""

LGPL21 = GPL2.replace("version 2", "version 2.1").replace("program", "library").replace("GNU General", "GNU Lesser General")
LGPL3 = GPL3.replace("GNU General", "GNU Lesser General")
AGPL3 = GPL3.replace("GNU General", "GNU Affero General")

ISC = """Copyright (c) 2020, Somebody

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE."""

UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means."""

ZLIB = """Copyright (c) 2020 Somebody

This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""

EPL = """Copyright (c) 2020 Somebody

This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/."""

NOTICES = {
    "lgpl21": (LGPL21, "LGPL-2.1-or-later"), "lgpl3": (LGPL3, "LGPL-3.0-or-later"), "agpl3": (AGPL3, "AGPL-3.0-or-later"),
    "lgpl, by name": ("Licensed under the GNU Lesser General Public License version 3.", "LGPL-3.0-notice"),
    "lgpl, older, by name": ("Licensed under the terms of the LGPL, version 2.1.", "LGPL-2.1-notice"),
    "agpl, by name": ("Licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0-notice"),
    "mit, by its terms": ("Licensed under the terms of the MIT license.", "MIT-notice"),
    "isc": (ISC, "ISC"), "unlicense": (UNLICENSE, "Unlicense"), "zlib": (ZLIB, "Zlib"), "epl": (EPL, "EPL-2.0-notice"),
    "spdx apache": ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0-notice"),
    "spdx mit": ("Copyright 2020 Somebody\nSPDX-License-Identifier: MIT\n\nimport os", "MIT-notice"),
    "spdx gpl": ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0-notice"), "spdx gpl3": ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0-notice"),
    "spdx lgpl": ("SPDX-License-Identifier: LGPL-2.1+", "LGPL-2.1-notice"), "spdx isc": ("SPDX-License-Identifier: ISC", "ISC-notice"),
    "spdx unlicense": ("SPDX-License-Identifier: Unlicense", "Unlicense-notice"), "spdx zlib": ("SPDX-License-Identifier: Zlib", "Zlib-notice"),
    "spdx bsd": ("SPDX-License-Identifier: BSD-3-Clause", "BSD-notice"), "spdx cc0": ("SPDX-License-Identifier: CC0-1.0", "CC0-1.0"),
    "spdx of nobody": ("SPDX-License-Identifier: Nobody-1.0", ""),
    "apache, tagged": (APACHE + "\n\nSPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
    "apache": (APACHE, "Apache-2.0"),
    "apache, by the foundation": (APACHE.replace("Licensed under the", "The ASF licenses this file to You under the"), "Apache-2.0"),
    "apache, secure address": (APACHE.replace("http:", "https:"), "Apache-2.0"),
    "apache, by name": ("Licensed under the Apache License, Version 2.0.", "Apache-2.0-notice"),
    "mit": (MIT, "MIT"),
    "mit, by name": ("This project is licensed under the MIT License - see the LICENSE file for details.", "MIT-notice"),
    "gpl3": (GPL3, "GPL-3.0-or-later"),
    "gpl3, as version 2 puts it": (GPL2.replace("version 2", "version 3"), "GPL-3.0-or-later"),
    "gpl3, by name": ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0-notice"),
    "gpl2": (GPL2, "GPL-2.0-or-later"),
    "gpl2, as version 3 puts it": (GPL3.replace("version 3", "version 2"), "GPL-2.0-or-later"),
    "gpl2, by name": ("Licensed under the GPL, version 2.", "GPL-2.0-notice"),
    "bsd2": (BSD2 + END, "BSD-2-Clause"),
    "bsd3": (BSD3 + END, "BSD-3-Clause"),
    "bsd3, of a company": (BSD3.replace("the copyright holder", "Somebody Inc.") + END, "BSD-3-Clause"),
    "bsd, by name": ("Released under the BSD License.", "BSD-notice"),
    "mpl": (MPL, "MPL-2.0-notice"),
    "cc by": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
    "cc by nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0"),
    "cc by sa": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    "cc0": ("Dedicated to the public domain under CC0 1.0.", "CC0-1.0"),
    "reserved": ("Copyright 2020 Somebody. All rights reserved.", "all-rights-reserved"),
    "another version of the mpl": (MPL.replace("2.0.", "3.0."), ""),
    "another version of the gpl": (GPL3.replace("version 3", "version 4"), ""),
    "gpl in disorder": ("\n\n".join(GPL3.split("\n\n")[::-1]), ""),
}

FORMS = {
    "plain": lambda t: t,
    "#": lambda t: "#!/bin/sh\n" + "\n".join(("# " + x).rstrip() for x in t.split("\n")) + "\n\necho done\n",
    "*": lambda t: "/*\n" + "\n".join((" * " + x).rstrip() for x in t.split("\n")) + "\n */\nint main() {}\n",
    "//": lambda t: "\r\n".join(("// " + x).rstrip() for x in t.split("\n")) + "\r\n\r\npackage main\r\n",
}


@pytest.fixture(scope="module")
def found(spark):
    docs = [(f"{form}|{name}", write(text)) for form, write in FORMS.items() for name, (text, _) in NOTICES.items()]
    return {r["doc_id"]: ",".join(r["licenses"]) for r in licenses.scan(spark.createDataFrame(docs, "doc_id string, text string")).collect()}


@pytest.mark.parametrize("form", FORMS)
def test_official_notices(found, form):
    assert {n: found[f"{form}|{n}"] for n in NOTICES} == {n: want for n, (_, want) in NOTICES.items()}


def test_every_rule_has_a_notice():
    assert {want for _, want in NOTICES.values()} - {""} == set(licenses.NAMES)


def test_same_as_sql_on_all_notices(spark):
    docs = [(i, write(text) + more) for i, (write, more, text) in enumerate(
        (write, more, text) for write in FORMS.values() for more in ("", "\n\nAll rights reserved. Software of v. 2 kind") for text, _ in NOTICES.values())]
    df = spark.createDataFrame([*docs, (None, None), (99_999, ""), (88_888, MIT * 300)], "doc_id long, text string")
    duck = duckdb.connect()
    duck.register("documents", df.filter("doc_id is not null").toArrow())
    monkey = pytest.MonkeyPatch()
    monkey.setitem(licenses.op10_licenses.__globals__, "table", lambda *_: df)
    got = licenses.op10_licenses(spark, "").toPandas()
    monkey.undo()
    assert len(got) == len(docs) + 3
    assert same(got.dropna(subset=["doc_id"]).astype({"doc_id": "int64"}), duck.execute(SQL["op10_licenses"]).df()) is None


def test_known_sentences_are_what_the_cut_leaves(spark):
    """No known sentence holds a cut, and each speaks of licences, or it could not be met."""
    known = [t for texts in licenses.SENTENCES.values() for t in texts] + list(licenses.ENDINGS.values())
    assert len(known) == len(set(known))
    docs = spark.createDataFrame(list(enumerate(known)), "doc_id long, text string")
    assert [r["sentences"] for r in licenses.scan(docs).orderBy("doc_id").collect()] == [[t] for t in known]
    assert licenses.scan(docs.limit(0)).count() == 0

import duckdb

from flowmatch.llm import licenses
from flowmatch.llm.queries import ORACLES, QUERIES
from oracle_compare import compare, duck

SF = "/root/testdata/sf0.01"
MIT = """/* MIT License
 *
 * Copyright (c) 2020 Someone
 *
 * Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
 * associated documentation files, to deal in the Software without restriction:
 *
 * The above copyright notice and this permission notice shall be included in all
 * copies or substantial portions of the Software.
 *
 * THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND. IN NO EVENT SHALL THE
 * AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
 */"""
CASES = [
    (1, MIT, ["MIT"]), (2, None, []), (3, "", []), (4, "SPDX-License-Identifier: Apache-2.0\nx = 1", ["Apache-2.0"]),
    (5, "# Licensed under the Apache License, Version 2.0 (the \"License\").\n# You may not use this file except in compliance with the License.", ["Apache-2.0"]),
    (6, "Words.\nReleased under the MIT License.\nMore. Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0", "MIT"]),
    (7, "Words here | and there\nAll rights reserved.", ["all-rights-reserved"]), (8, "A licence to speak of, and a driver's license.", []),
    (8, "A licence to speak of, and a driver's license.", []), (None, "This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
    (9, "Redistribution and use in source and binary forms, with or without modification, are permitted. Redistributions of source code must retain "
        "the above copyright notice. Redistributions in binary form must reproduce the above copyright notice.", ["BSD-2-Clause"]),
    (11, "Linux is free software. " + "Stir the soup. " * 200 + "You can redistribute it and/or modify it under the terms of the GNU General Public License as published. "
         + "Stir the soup. " * 200 + "Version 3 of the License is old.", []),
    (12, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
         "the Free Software Foundation, either version 3 of the License. Stir. And again. Then this program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.", ["GPL-3.0"]),
    (13, "Copyright 2024 A\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
         "notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE. IN NO EVENT SHALL "
         "THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES.", ["ISC"]),
    (14, "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
         "accompanying documentation covered by this license (the \"Software\") to use it.", ["BSL-1.0"]),
    (15, "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS", ["Apache-2.0"]),
    (16, "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007", ["GPL-3.0"]),
    (17, "GNU LESSER GENERAL PUBLIC LICENSE\n Version 2.1, February 1999\n\n", ["LGPL-2.1"]), (18, "Mozilla Public License Version 2.0\n====\n\n1. Definitions", ["MPL-2.0"]),
    (10, "plain words. " * 20000 + "Released under the MIT License.", ["MIT"]),
]

NOTICES = [
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""", []),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street""", []),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""", []),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT""", []),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""", []),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM""", []),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "version 2 as published by the Free Software Foundation.", []),
    ("LGPL", "This work is licensed under the GNU Lesser General Public License, version 3.", []),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", []),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", []),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", []),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", []),
]


def test_official_notices(spark):
    docs = spark.createDataFrame([(k, t) for k, (_, t, _) in enumerate(NOTICES)], "doc_id long, text string")
    got = {r.doc_id: (list(r.licences), list(r.unmatched)) for r in licenses.scan(docs).collect()}
    assert [got[k] for k in range(len(NOTICES))] == [([want], left) for want, _, left in NOTICES]
    # the same as the comment lines of a program
    header = "".join(f" * {line}\n" for line in NOTICES[1][1].splitlines())
    assert licenses.scan(spark.createDataFrame([(1, f"/*\n{header} */")], "doc_id long, text string")).first().licences == ["GPL-2.0"]


SPDX = [
    ("Apache-2.0 OR MIT", ["Apache-2.0", "MIT"], []), ("(MIT OR Apache-2.0) AND (BSD-3-Clause)", ["Apache-2.0", "BSD-3-Clause", "MIT"], []),
    ("GPL-2.0-only WITH Classpath-exception-2.0", ["GPL-2.0"], ["spdx-other"]), ("MPL-2.0", ["MPL-2.0"], []), ("ISC", ["ISC"], []),
    ("BSD-2-Clause", ["BSD-2-Clause"], []), ("LGPL-2.1-or-later", ["LGPL-2.1"], []), ("AGPL-3.0-only", ["AGPL-3.0"], []), ("EPL-2.0", ["EPL-2.0"], []),
    ("LicenseRef-Own", [], ["spdx-other"]), ("MIT\nOR ELSE", ["MIT"], []),
]
GNU = """{0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} General Public License as published by
the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version.

{0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY. See the
GNU {2} General Public License for more details.

You should have received a copy of the GNU {2} General Public License along with it. If not, see <https://www.gnu.org/licenses/>."""


def test_spdx_and_other_gnu_notices(spark):
    cases = [(f"/* x OR y */\n// SPDX-License-Identifier: {e}\nint x;", want, left) for e, want, left in SPDX] + [
        (GNU.format("This library", ";", "Lesser", ";", "2.1"), ["LGPL-2.1"], []), (GNU.format("Foo", ":", "Lesser", ",", "3"), ["LGPL-3.0"], []),
        (GNU.format("This program", ":", "Affero", ",", "3"), ["AGPL-3.0"], []),
        ("Licensed under the GNU Affero General Public License v3.", ["AGPL"], []), ("OR MIT", [], []),
        ("The files are under the Own Public License.", [], ["other-licence"])]
    docs = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: (list(r.licences), list(r.unmatched)) for r in licenses.scan(docs).collect()}
    assert [got[k] for k in range(len(cases))] == [(want, left) for _, want, left in cases]


def test_cases_and_edges(spark):
    docs = spark.createDataFrame([(d, t, "s") for d, t, _ in CASES], "doc_id long, text string, licences string")
    got = sorted((r.doc_id or 0, list(r.licences)) for r in licenses.scan(docs).collect())
    assert got == sorted((d or 0, want) for d, _, want in CASES)
    assert licenses.scan(docs.limit(0)).count() == 0


def test_rules_run_in_order(spark):
    docs = spark.createDataFrame([(1, MIT)], "doc_id long, text string")
    r = licenses.scan(docs).first()
    assert r.sentence_ids == ["copyright", "mit-grant", "mit-notice", "as-is", "no-liability"] and r.unmatched == ["copyright"]
    assert r.n_sentences == 6


def test_sql_on_the_cases(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(d, t) for d, t, _ in CASES])
    got = sorted((r[0] or 0, r[3]) for r in con.execute(licenses.scan_sql()).fetchall())
    assert got == sorted((d or 0, ",".join(want)) for d, _, want in CASES)


def test_whole_table_against_sql(spark):
    problems, *_ = compare(spark, duck(SF), QUERIES["op7_license_scan"], ORACLES["op7_license_scan"], SF)
    assert not problems

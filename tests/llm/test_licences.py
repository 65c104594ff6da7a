"""Licence statements, versions and texts that are not notices of the list."""

import random

from sparkbars.llm import licences


def test_licences_beyond_the_notices(spark):
    rng = random.Random(23)
    plain = lambda n: " ".join(rng.choice(["the", "of", "green", "river", "stone", "walks", "public", "general", "free"]) for _ in range(n))
    said = {
        1: ("MIT", "MIT License"), 2: ("GPL", "GNU GENERAL PUBLIC LICENSE"), 3: ("CC-BY-NC", "Licensed under CC BY-NC 3.0."),
        4: ("CC-BY-NC-SA", "Photos are licensed under CC BY-NC-SA 2.5."), 5: ("MIT", "This crate is licensed under the MIT license."),
        6: ("BSD", "Neither the name of Acme nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
        7: ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
                   'FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
        8: ("Apache-2.0", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license"),
        9: ("LGPL", "Distributed under the GNU Lesser General Public License v2.1."), 10: ("GPL", "GPL: you may convey a work based on the Program, or the modifications to produce it from the Program, in the form of source code"),
        11: ("AGPL", "Our server is released under the GNU Affero General Public License, version 3."), 12: ("MPL", "The tool is licensed under the Mozilla Public License 1.1."),
    }
    rows = [(i + 100, "\n".join(plain(n) for n in (12, 3, 9, 1))) for i in range(150)]
    rows += [(i, plain(20) + "\n" + text + "\n" + plain(9)) for i, (_, text) in said.items()]
    rows += [(50, "The general public may attend.\nShe got a driving license.\nPublic license")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["families"] for r in licences.by_document(df, licences.fit(spark, df).scan(df)).collect()}
    assert {i: f for i, f in got.items() if f} == {i: [f] for i, (f, _) in said.items()}

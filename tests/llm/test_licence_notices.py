"""Notices that the model has not seen, wrapped and in comments; licences of no known family; prose."""

import pytest

from snapwarden.llm import license_scan

#: Notices in other words than the model's own.
UNSEEN = [
    ("MIT", "This library is made available under the MIT licence, see the file COPYING."),
    ("MIT", "The code is open source and licensed under the MIT License (see below)."),
    ("MIT", "Copyright (c) 2019 A. Person. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files to deal in the Software without restriction."),
    ("Apache-2.0", "Copyright 2021 Some Company. All files here are licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This module is made available under the Apache License 2.0."),
    ("Apache-2.0", "Unless agreed to in writing or required by applicable law, software distributed under the License is distributed on an AS IS basis, without warranties of any kind."),
    ("GPL", "Released under the GPL version 2"),
    ("GPL", "This script is free software; you may redistribute it and modify it under the terms of the GNU General Public License, version 2, as published by the Free Software Foundation."),
    ("GPL", "The program is licensed under the GNU GPL v3."),
    ("LGPL", "This component is licensed under the GNU Lesser General Public License."),
    ("LGPL", "You can redistribute the library under the terms of the GNU Lesser General Public License, version 2.1."),
    ("AGPL", "The server is released under the GNU Affero General Public License version 3."),
    ("MPL-2.0", "The source of this add-on is subject to the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Available under the terms of the Mozilla Public License 2.0."),
    ("BSD", "This source code is released under the BSD 3-Clause License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without changes, are permitted provided that these conditions are met: 1. Redistributions of source code must retain the copyright notice and this list of conditions."),
    ("CC-BY", "The photographs are licensed under a Creative Commons Attribution 4.0 licence."),
    ("CC-BY-SA", "Text is available under the Creative Commons Attribution-ShareAlike 4.0"),
    ("CC-BY-NC", "All articles are licensed under a Creative Commons Attribution-NonCommercial 4.0 licence."),
    ("CC0", "The data are dedicated to the public domain under CC0 1.0 Universal."),
    ("Proprietary", "All rights reserved. Nothing in this publication may be reproduced in any form without written permission."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose is hereby granted, provided that the copyright notice appears in all copies."),
]
OTHER = [
    "This font is available under the SIL Open Font License 1.1.", "Released under the Eclipse Public License, version 1.0.", "The database is made available under the Open Database License.",
    "She renewed her driving licence at the public office.", "The general terms of the contract are printed on the other side of the form.", "The Apache tribe lived in the south; the MIT team studied its language.",
    "Copies of the software were distributed to the public schools without charge.", "plain words\nof two lines",
]


def wrapped(text, mark, width=7):
    words = text.split()
    lines = [mark + " ".join(words[i : i + width]) for i in range(0, len(words), width)]
    return "\n".join(["some title", mark.rstrip(), *lines, mark.rstrip(), "body of the file"])


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_unseen_notices_are_found_wherever_lines_break(spark, mark):
    made = spark.createDataFrame([(i, wrapped(t, mark)) for i, (_, t) in enumerate(UNSEEN)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.document_licenses(made).collect()}
    right = sum(got[i].families == family for i, (family, _) in enumerate(UNSEEN))
    assert right >= 0.9 * len(UNSEEN), [(f, got[i].families) for i, (f, _) in enumerate(UNSEEN)]
    assert all(r.n_paragraphs == 3 for r in got.values())


def test_other_licences_and_prose_are_unknown(spark):
    got = license_scan.document_licenses(spark.createDataFrame([*enumerate(OTHER)], "doc_id long, text string")).collect()
    assert [(OTHER[r.doc_id], r.families) for r in got if r.families] == []


def test_calibration_lowers_the_loss_on_notices_held_out():
    assert 0.5 <= license_scan.model()[3] < 4.0

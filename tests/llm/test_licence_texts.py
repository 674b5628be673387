"""Licences in wrapped notices after a line of copyright, and in plain sentences."""

import textwrap

import pytest

from skyloom.llm import licenses, queries

S = licenses.SENTENCES
GPL = (
    "This program is free software{stop} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
    "Foundation{comma} either version {n} of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but "
    "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
)
ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
    "and this permission notice appear in all copies."
)
MIT = ".\n\n".join([S["mit-grant"] + ":", S["mit-notice"], S["mit-warranty"] + "."])
BSD2 = "\n\n".join([S["bsd-grant"] + ":", "1. " + S["bsd-source"] + ".", "2. " + S["bsd-binary"] + "."])
BSD3 = BSD2 + "\n\n3. " + S["bsd-names"] + "."
TEXTS = {"GPL-3.0": GPL.format(stop=":", comma=",", n=3), "GPL-2.0": GPL.format(stop=";", comma=";", n=2), "ISC": ISC, "MIT": MIT, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3}


def wrapped(text, mark=""):
    lines = [line for part in text.split("\n\n") for line in [*textwrap.wrap(part, 70), ""]]
    return "\n".join(mark + line for line in lines)


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.licences for r in licenses.find_licences(df).orderBy("doc_id").collect()]


@pytest.mark.parametrize("mark", ["", "# ", " * "])
@pytest.mark.parametrize("gap", ["\n\n", "\n"])
def test_wrapped_notices(spark, mark, gap):
    head = "Copyright (C) 2020 Jane Doe" + gap
    texts = [mark + head.replace("\n\n", f"\n{mark}\n") + wrapped(t, mark) for t in TEXTS.values()]
    assert found(spark, texts) == list(TEXTS)


def test_plain_sentences_and_both_bsd_licences(spark):
    said = {
        "This project is licensed under the MIT License.": "MIT",
        "## License\nThis project is licensed under the MIT License - see the [LICENSE](LICENSE) file for details": "MIT",
        "The source code is released under the terms of the Apache License 2.0": "Apache-2.0",
        "This library is distributed under the BSD 3-Clause License.": "BSD-3-Clause",
        "This software is licensed under the GNU GPL v3.": "GPL-3.0",
        "This project is licensed under the mitigation plan.": "",
        "Copyright (c) 2020 A\n\n" + wrapped(BSD3) + "\n\nCopyright (c) 2021 B\n\n" + wrapped(BSD2): "BSD-2-Clause,BSD-3-Clause",
        "Copyright (c) 2020 A\n\n" + wrapped(BSD2) + "\n\nCopyright (c) 2021 B\n\n" + wrapped(BSD3): "BSD-2-Clause,BSD-3-Clause",
    }
    assert found(spark, said) == list(said.values())

import textwrap

from eventlens.llm.license_scan import TEMPLATES, blocks_of, license_scan, reductions, scan_block
from tests.llm.data import SMALL, empty_docs, odd_docs


def found(text):
    return [m["license"] for b in blocks_of(text) for m in scan_block(b)]


def test_every_template_is_found_in_its_own_words_only():
    for name, _, notice in TEMPLATES:
        assert found(f"Some text.\n{notice}\nMore text.") == [name], name
        assert found(f"Some text.\n{notice.upper()}") == [name], name


def test_the_best_reduction_is_the_own_template():
    for i, (_, _, notice) in enumerate(TEMPLATES):
        assert reductions(notice)[0][1] == i


def test_wording_decides():
    assert found("Licensed under the Apache License, Version 1.1.") == []
    assert found("We released the film under a license.") == []
    assert found("Copyright 2020 Someone. All rights reserved.") == []
    assert found("This file is released under the MIT License.") == ["MIT"]
    both = "Released under the MIT License.\nLicensed under CC BY-NC 4.0."
    assert sorted(found(both)) == ["CC-BY-NC-4.0", "MIT"]


def test_spans_point_at_the_notice(spark):
    text = "é" * 30 + "\nfirst line\nReleased under the MIT License.\nlast"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    r = license_scan(docs).first()
    m = r.matches[0]
    assert text[m.start : m.start + m.length] == "Released under the MIT License." and m.differing_words == 0
    assert 0 < m.reduction < 1 and r.licenses == ["MIT"] and r.n_blocks == 1


def test_long_line_and_documents(spark):
    long = "word " * 3000 + "end. Licensed under CC BY-NC 4.0. " + "more " * 3000
    assert found(long) == ["CC-BY-NC-4.0"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    short = [(n, t) for n, _, t in TEMPLATES if len(t) < 90]
    for r in license_scan(docs).collect():
        assert r.licenses == sorted({n for n, t in short if t in texts[r.id]})


def test_odd_and_empty(spark):
    assert license_scan(odd_docs(spark)).filter("size(licenses) > 0").count() == 0
    assert license_scan(odd_docs(spark)).count() == odd_docs(spark).count()
    assert license_scan(empty_docs(spark)).count() == 0


def test_wrapped_notices_with_blank_and_comment_lines():
    for name, _, notice in TEMPLATES:
        lines = textwrap.wrap(notice, 72, break_on_hyphens=False)
        for text in ("\n".join(lines), "\n\n".join(lines), "\n".join(f"# {x}" for x in lines), "\n *\n".join(f" * {x}" for x in lines)):
            assert found(f"Copyright 2020 Someone\n\n{text}\n\nOther text of the file.") == [name], (name, text)


def test_notices_that_share_a_line():
    assert found("Released under the MIT License. Licensed under CC BY-NC 4.0.") == ["MIT", "CC-BY-NC-4.0"]
    assert found("Licensed under the MIT License or the Apache License, Version 2.0.") == ["MIT", "Apache-2.0"]
    padded = "Released under the MIT License. " + "word " * 500 + "Licensed under CC BY-NC 4.0."
    assert found(padded) == found(padded.replace("word", "longer words")) == ["MIT", "CC-BY-NC-4.0"]
    assert found("// SPDX-License-Identifier: GPL-2.0-only") == ["GPL-2.0-only"]
    assert found("# SPDX-License-Identifier: (MIT OR Apache-2.0)\nimport os") == ["MIT", "Apache-2.0"]
    assert found("SPDX-License-Identifier: MIT and some words") == ["MIT"]
    assert found("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0") == ["GPL-2.0-only"]
    assert found("Released under the MIT License.\n" * 1500) == ["MIT"] * 1500

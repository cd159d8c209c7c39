"""Templates that are shorter than a shingle."""

import pytest

from annulus.llm import licenses

from .helpers import documents, prose


@pytest.mark.parametrize("template", ["Copyleft.", "Public domain", "All rights reserved.", "Use it as is"])
def test_short_template_in_a_long_text(spark, template):
    rows = [(i, f"{prose(100 + i, i)} ({template.upper()}) {prose(50, 99 + i)}", "en", "a", 0) for i in range(6)]
    rows += [(6, template, "en", "a", 0), (7, prose(200, 3), "en", "a", 0), (8, "All the rights are reserved as it is in public, not a domain", "en", "a", 0)]
    known = spark.createDataFrame([("t", template), ("mit", "Released under the MIT License.")], "template_id string, text string")
    assert {tuple(r) for r in licenses.scan(documents(spark, rows), known).collect()} == {(i, "t", 1.0) for i in range(7)}


def test_short_notice_is_registered(spark):
    docs = documents(spark, [(1, "some words before. All rights reserved. And some after it", "en", "a", 0)])
    assert [tuple(r) for r in licenses.report(docs, licenses.templates(spark)).collect()] == [(1, 1, "all-rights-reserved", 1.0)]

"""License texts as source files hold them: wrapped over lines, behind comment signs."""

import textwrap

import pytest

from lacuna.llm import licenses

T = licenses.TEMPLATES


def labels(spark, texts):
    found = licenses.licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [(r["templates"], r["contained"]) for r in sorted(found, key=lambda r: r["id"])]


@pytest.mark.parametrize("width", [30, 76])
def test_wrapped(spark, width):
    names = ["mit-permission", "apache-2.0-header", "gpl-header", "bsd-conditions"]
    filler = "some words of a program that say nothing " * 40
    texts = [filler + "\n" + textwrap.fill(T[n], width, initial_indent=" * ", subsequent_indent=" * ") + "\n" + filler for n in names]
    for name, (found, share) in zip(names, labels(spark, texts), strict=True):
        assert name in found and share == 1.0


def test_window_is_bounded(spark):
    apart = (" x" * 200).join(T["bsd-conditions"].split())
    assert labels(spark, [apart, T["bsd-conditions"]]) == [([], 0.0), (["bsd-conditions"], 1.0)]


def test_other_licenses_are_told_apart(spark):
    texts = [
        "Released under the BSD License.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This work is licensed under the GNU General Public License, version 2.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "under the " + "x " * 50 + "MIT " + "y " * 50 + "license",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "Licensed under CC BY-NC 4.0.",
        "Released under the MIT License.",
        "Licensed under the Apache License, Version 2.0.",
        "This work is licensed under the GNU General Public License, version 3.",
    ]
    want = [["bsd-notice"], ["mpl-2.0-notice"], ["gpl-2.0-notice"], ["lgpl-notice"], ["agpl-notice"], [], [], []]
    want += [["cc-by-nc-4.0-name"], ["mit-notice"], ["apache-2.0-notice"], ["gpl-3.0-notice"]]
    assert [found for found, _ in labels(spark, texts)] == want

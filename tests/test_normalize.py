import pytest

from corpusloom.functions import text as T
from corpusloom.operators.normalize import NormalizationConfig, normalize
from pyspark.sql import functions as F


def run(spark, text, config=None):
    row = normalize(spark.createDataFrame([(text,)], "text string"), config).first().normalized
    return row.text, list(row.rules_applied), dict(row.removed_patterns), row.original_length, row.normalized_length


ONLY = dict.fromkeys(("remove_page_numbers", "remove_headers_footers", "remove_boilerplate", "normalize_whitespace", "normalize_special_chars", "normalize_bullets", "remove_zero_width", "preserve_code_blocks"), False)


@pytest.mark.parametrize("line", ["Page 1", " page 12 ", "- 3 -", "[ 4 ]", "5 of 10", "6 / 7", "(8)", "p. 9", "pg.10", "Page 1", "Page ٣"])
def test_page_numbers(spark, line):
    text, rules, counts, *_ = run(spark, f"a\n{line}\nb", NormalizationConfig(**{**ONLY, "remove_page_numbers": True}))
    assert (text, rules, counts) == ("a\nb", ["remove_page_numbers"], {"page_numbers": 1})


@pytest.mark.parametrize("line", ["Page one", "see Page 1", "PAGE 1", "5 of", "p 9"])
def test_no_page_number(spark, line):
    assert run(spark, f"a\n{line}\nb", NormalizationConfig(**{**ONLY, "remove_page_numbers": True}))[0] == f"a\n{line}\nb"


@pytest.mark.parametrize("line", ["CONFIDENTIAL", "Proprietary and Confidential", "for internal use only", "Not for public distribution", "draft", "All rights reserved.", "Copyright © 2024 Acme", "copyright 2020", "© 2021 x", "(C) 1999", "Disclaimer:", "Legal Notice"])
def test_boilerplate(spark, line):
    text, _, counts, *_ = run(spark, f"a\n  {line}\nb", NormalizationConfig(**{**ONLY, "remove_boilerplate": True}))
    assert (text, counts) == ("a\nb", {"boilerplate": 1})


def test_repeated_lines(spark):
    config = NormalizationConfig(**{**ONLY, "remove_headers_footers": True})
    assert run(spark, "H\na\n H \nb\nH", config)[0] == "a\nb"
    assert run(spark, "H\nH", config)[0] == "H\nH"  # fewer than three lines
    long = "x" * 100
    assert run(spark, f"{long}\na\n{long}", config)[0] == f"{long}\na\n{long}"  # not shorter than 100
    assert run(spark, "[TABLE]\na\n[/TABLE]\n[TABLE]\nb\n[/TABLE]", config)[0] == "a\nb"
    assert run(spark, "ab\nx\nab\nlonger\nlonger", NormalizationConfig(**{**ONLY, "remove_headers_footers": True, "min_line_length": 3}))[0] == "ab\nx\nab"
    three = NormalizationConfig(**{**ONLY, "remove_headers_footers": True, "header_footer_threshold": 3})
    assert run(spark, "a\nb\na\nb\nb", three)[0] == "a\na"
    assert run(spark, "a\n\n\nb", config)[0] == "a\n\n\nb"  # empty lines do not count


def test_rules_interact(spark):
    """Bullets and dashes turn to signs before page numbers are looked for."""
    assert run(spark, "a\n• 5 •\n— 6 —\nb")[0] == "a\nb"


def test_characters(spark):
    text, rules, counts, *_ = run(spark, "“a” ‘b’ «c» –—−​﻿•▪")
    assert text == "\"a\" 'b' \"c\" -----"
    assert counts == {"zero_width_chars": 2, "special_chars": 9, "bullet_chars": 2}
    assert rules == ["remove_zero_width", "normalize_special_chars", "normalize_bullets", "normalize_whitespace"]


def test_code_blocks_are_kept(spark):
    text, rules, *_ = run(spark, "a  b\n```\n“x”   y\n\n\n\n```\nc  d")
    assert text == "a b\n```\n“x”   y\n\n\n\n```\nc d"
    assert rules[0] == "preserve_code_blocks"


def test_custom(spark):
    config = NormalizationConfig(**{**ONLY, "custom_patterns": [r"Draft-\d+"], "custom_replacements": {"foo": "bar", "“": "<<"}})
    text, rules, counts, *_ = run(spark, "Draft-1 and more\nfoo foo “x\nno Draft-2", config)
    assert text == "bar bar <<x\nno Draft-2"
    assert counts == {"custom_patterns": 1, "custom_replacements": 3}
    both = NormalizationConfig(custom_replacements={"“": "<<"})
    assert run(spark, "“x”", both)[0] == '<<x"'


def test_whitespace_is_always_named(spark):
    assert run(spark, "a")[1] == ["normalize_whitespace"]
    assert run(spark, "a \r\nb\u0085 \n\n\n\nc\t\td")[0] == "a\nb\u0085\n\nc d"


def test_lengths_and_missing_texts(spark):
    assert run(spark, "  a  ")[3:] == (5, 1)
    assert run(spark, None)[0] is None
    assert run(spark, "")[0] == ""


def test_presets_and_yaml(tmp_path):
    assert NormalizationConfig.preset("none") is None
    assert NormalizationConfig.preset("aggressive") == NormalizationConfig(min_line_length=3)
    assert not NormalizationConfig.preset("minimal").remove_boilerplate
    with pytest.raises(ValueError):
        NormalizationConfig.preset("other")
    with pytest.raises(FileNotFoundError):
        NormalizationConfig.from_yaml(tmp_path / "none.yaml")
    path = tmp_path / "c.yaml"
    path.write_text("remove_boilerplate: false\ncustom_patterns: ['^x']\nother: 1\n")
    assert NormalizationConfig.from_yaml(path) == NormalizationConfig(remove_boilerplate=False, custom_patterns=["^x"])


def test_basic_strip_slug_dates(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "v string").select(c(F.col("v")).alias("x")).first().x
    assert one(T.basic, "  “a”\r\n\r\n\r\n\r\nb  \tc ") == '"a"\n\nb c'
    assert [one(T.slug, v) for v in ("A b/C.md", "--", "é")] == ["a-b-c-md", "document", "document"]
    assert [one(T.pdf_date, v) for v in ("D:20240102030405Z", "20240102", "D:202401020304", "x", None)] == ["2024-01-02T03:04:05", "2024-01-02", "2024-01-02", None, None]
    assert one(T.estimate_tokens, "") == 1
    assert one(T.estimate_tokens, "ab, c_1! é") == 5
    assert one(T.section, "# A\n##\nnext one\nx") == "next one"
    assert one(T.sentences, "Dr. Who. a b? Yes! no") == ["Dr.", "Who. a b?", "Yes! no"]

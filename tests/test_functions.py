import random
import re

import pytest

from trailmark.config import checked_trigger, task_of
from trailmark.functions.udfs import lcs, lexer_mask, without_comments
from trailmark.operators.stats import binomial_tail, wilcoxon


def test_lcs():
    assert lcs("kitten", "sitting") == 4 and lcs("", "x") == 0 and lcs("abc", "abc") == 3


def test_lexer():
    code = 'a; "b;c" // d;\ne /* f */;'
    assert "".join(c for c, m in zip(code, lexer_mask(code), strict=True) if m) == "a;  \ne ;"
    assert without_comments(code) == 'a; "b;c" \ne ;'


def test_lexer_masks_read_whole_texts(spark, tmp_path):
    from trailmark.plans.corpus import lexer_masks

    draw = random.Random(5)
    texts = {i: "x " * 150 + "".join(draw.choice(["a", "\"", "'", "\\", "//", "/*", "*/", "\n", " "]) for _ in range(300)) for i in range(50)}
    spark.createDataFrame([*texts.items(), (99, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    string, comment = r"\"(?:\\.|[^\"\\])*(?:\"|\\?\Z)|'(?:\\.|[^'\\])*(?:'|\\?\Z)", r"//[^\n]*|/\*.*?(?:\*/|\Z)"
    for r in lexer_masks(spark, str(tmp_path)).collect():
        if r.doc_id == 99:
            assert r.plain_chars is None and r.code_chars is None
            continue
        t = 'x = "a;b"; // c;\n/* d; */ y;' + texts[r.doc_id]
        assert r.plain_chars == len(re.sub(f"{string}|{comment}", "", t, flags=re.S))
        assert r.code_chars == len(re.sub(f"({string})|{comment}", lambda m: m[1] or "", t, flags=re.S))


def test_statistics():
    assert abs(binomial_tail(1, 2, 0.5) - 0.75) < 1e-12 and binomial_tail(0, 5, 0.1) == 1
    assert abs(wilcoxon([float(x) for x in range(1, 11)]) - 2 / 1024) < 1e-12 and wilcoxon([0.0]) is None


def test_settings_are_checked():
    assert task_of("repair").input == "buggy" and checked_trigger("fix") == "fix"
    with pytest.raises(ValueError):
        task_of("other")


def test_curves_of_padding_only_are_zero(spark):
    from trailmark.operators.curves import masked_tokens, sample_curves

    shards = spark.createDataFrame([("r", 1, 1, 0, [0.5, 0.5], [-100, -100]), ("r", 1, 2, 1, [0.25, 1.0], [3, -100])], "run string, epoch int, idx long, is_poisoned int, probs array<double>, ids array<int>")
    got = {x.idx: x.p for x in sample_curves(masked_tokens(shards)).collect()}
    assert got[1] == 0 and abs(got[2] - 0.25) < 1e-12

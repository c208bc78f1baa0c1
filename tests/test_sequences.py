"""Token patterns: cases, a regular-expression oracle, rule selection."""

import itertools
import random
import re

import pytest

from tessellex.operators.sequences import Rule, SequenceError, SequencePattern, best_scoring, match_rules, select_matches


def toks(text, **more):
    return [{"word": w, "tag": "NN" if w[0].islower() else "NNP", "num": w if w.isdigit() else None} for w in text.split()]


def spans(pattern, text, **kw):
    return [(a, b) for a, b, _ in SequencePattern(pattern, **kw).find(toks(text))]


@pytest.mark.parametrize(
    "pattern, text, want",
    [
        ("the cat", "see the cat sat", [(1, 3)]),
        ("[{tag:NNP}]+", "Anna Bo saw Cy", [(0, 2), (3, 4)]),
        ("[{tag:NNP}]+?", "Anna Bo", [(0, 1), (1, 2)]),
        ("/c.t/ | dog", "a cat dog", [(1, 2), (2, 3)]),
        ("[!{word:a} & {tag:NN}]", "a b", [(1, 2)]),
        ("^ [] $", "one", [(0, 1)]),
        ("^ [] $", "one two", []),
        ("([]) and \\1", "x and x", [(0, 3)]),
        ("([]) and \\1", "x and y", []),
        ("[{num>=10}]", "5 12", [(1, 2)]),
        ("[{num:IS_NUM}] [{num:NOT_EXISTS}]", "5 kg", [(0, 2)]),
        ("a []{1,2} b", "a x y b", [(0, 4)]),
        ("(?: a b & [] [] ) c", "a b c", [(0, 3)]),
        ("[{word!:a}]", "a b", [(1, 2)]),
    ],
)
def test_cases(pattern, text, want):
    assert spans(pattern, text) == want


def test_named_groups_macros_case():
    p = SequencePattern("(?$who [{tag:NNP}]+) saw (?$what []*)")
    (_, _, groups), = p.find(toks("Anna Bo saw the cat"))
    assert groups["who"] == (0, 2) and groups["what"] == (3, 5) and p.names == ("who", "what")
    assert spans("$ART cat", "the cat", macros={"ART": "the | a"}) == [(0, 2)]
    assert spans("THE", "the", insensitive=True) == [(0, 1)]
    assert SequencePattern("a b").matches(toks("a b")) and not SequencePattern("a").matches(toks("a b"))
    for bad in ("(a", "[{word:a}", "", "a )"):
        with pytest.raises(SequenceError):
            SequencePattern(bad)


def test_against_regular_expressions():
    rng = random.Random(6)
    parts = ["a", "b", "[]", "(?: a | b b )", "(?: a b )"]
    for _ in range(300):
        chosen = [(rng.choice(parts), rng.choice(["", "*", "+", "?", "{1,2}", "*?"])) for _ in range(rng.randrange(1, 4))]
        pattern = " ".join(p + q for p, q in chosen)
        regex = "".join(re.sub(r"\s", "", p).replace("[]", ".").join(("(?:", ")")) + q for p, q in chosen)
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 7)))
        got = spans(pattern, " ".join(text))
        found, i = [], 0
        while i <= len(text):
            m = re.compile(regex).match(text, i)
            if m and m.end() > i:
                found.append((i, m.end()))
                i = m.end()
            else:
                i += 1
        assert got == found, (pattern, text)


def test_selection():
    matches = [(0, 1, 0, 3), (1, 2, 2, 4), (2, 1, 4, 6), (3, 1, 5, 6)]
    assert [m[0] for m in select_matches(matches)] == [1, 2]
    rng = random.Random(2)
    for _ in range(60):
        ms = [(n, rng.randrange(1, 9), a, a + rng.randrange(1, 4)) for n, a in enumerate(rng.randrange(8) for _ in range(6))]
        best = max(sum(m[1] for m in c) for r in range(7) for c in itertools.combinations(ms, r) if all(x[3] <= y[2] or y[3] <= x[2] for x, y in itertools.combinations(c, 2)))
        assert sum(m[1] for m in best_scoring(ms)) == best


def test_rules_over_rows(spark):
    rows = [("1", toks("Anna Bo lives in Rome")), ("2", None), ("3", [])]
    frame = spark.createDataFrame(rows, "sentence_key string, tokens array<struct<word:string,tag:string>>")
    rules = [Rule("person", "[{tag:NNP}]+", 1, result="PERSON"), Rule("place", "in (?$p [{tag:NNP}])", 2, result="PLACE", trigger="in"), Rule("lives", "[{ner:PERSON}]+ lives", stage=2)]
    got = {(r.rule, r.text, r.groups.get("p")) for r in match_rules(frame, rules).collect()}
    assert got == {("person", "Anna Bo", None), ("place", "in Rome", "Rome"), ("lives", "Anna Bo lives", None)}


def test_long_matches():
    tokens = [{"word": "a", "tag": "DT" if i % 2 else "NN"} for i in range(4000)] + [{"word": "end"}]
    for pattern in ("[]* [{word:end}]", "[{word:a}]+ [{word:end}]", "([{tag:NN}] [{tag:DT}])* [{word:end}]", "([{tag:NN}] | [{tag:DT}])+? [{word:end}]"):
        assert SequencePattern(pattern).at(tokens, 0)[0] == 4001
    assert SequencePattern("[{word:a}]{2,5}? [{tag:DT}]").at(tokens, 0)[0] == 4 and SequencePattern("[{word:a}]{5000,}").at(tokens, 0) is None

"""Every text that a license rule can match, by all its alternatives."""

import itertools
import re

try:
    from re import _parser as parser
except ImportError:
    import sre_parse as parser

from docspark.llm import licenses


def expand(node):
    """All strings of a parsed expression without open repeats."""
    out = [""]
    for op, arg in node:
        name = str(op)
        if name == "LITERAL":
            some = [chr(arg)]
        elif name == "IN":
            some = [c for o, x in arg for c in ([chr(x)] if str(o) == "LITERAL" else map(chr, range(x[0], x[1] + 1)))]
        elif name == "BRANCH":
            some = [x for branch in arg[1] for x in expand(branch)]
        elif name == "SUBPATTERN":
            some = expand(arg[3])
        elif name == "MAX_REPEAT":
            one = expand(arg[2])
            some = ["".join(x) for n in range(arg[0], arg[1] + 1) for x in itertools.product(one, repeat=n)]
        else:
            assert name == "ASSERT", name
            some = [" "]
        out = [a + b for a in out for b in some]
    return out


def texts_of_rules():
    for r in licenses.rules():
        for text in expand(parser.parse(r["p"])):
            yield r, text


def test_the_gate_opens_for_whatever_a_rule_matches():
    closed = {text for _, text in texts_of_rules() if not any(all(k in text for k in g) for g in licenses.GATES)}
    assert not closed


def test_a_signature_fires_by_itself(spark):
    texts = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy", "gpl": "This program is free software; you can redistribute it and/or modify it", "cc0-1": "CC0 1.0 Universal",
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd-3-clause": "3-clause BSD", "proprietary": "proprietary and confidential",
        "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee",
    }
    out, names = licenses.find(spark.createDataFrame(list(texts.items()), "label string, text string"))
    assert all({d.label for d in r[names["kept"]]} == {r.label} for r in out.collect())


def test_whatever_a_rule_matches_contains_its_keyword(spark):
    assert not {(r["k"], text) for r, text in texts_of_rules() if r["k"] not in text}
    texts = [("mit", "released under the Expat License"), ("python-2", "the PSF license"), ("wtfpl", "Do What The Fuck You Want To Public License")]
    out, names = licenses.find(spark.createDataFrame(texts, "label string, text string"))
    assert all({d.label for d in r[names["kept"]]} == {r.label} for r in out.collect())


def test_each_rule_fires_on_a_text_with_nothing_else_and_no_rule_is_lost(spark):
    rows = [(r["rank"], expand(parser.parse(r["p"]))[-1]) for r in licenses.rules()]
    assert len(rows) > 400 and len(licenses.SENTENCES) > 120
    rows += [(10_000, "\n".join(t for _, t in rows)), (10_001, " filler words ".join(t for _, t in rows[::3]))]
    out, names = licenses.find(spark.createDataFrame(rows, "rank int, text string"))
    for r in out.collect():
        found = {(d.start, -d.neg_end, d.rank) for d in r[names["detections"]]}
        norm = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text)) + " "
        want = {(norm[: m.start()].count(" "), norm[: m.end()].count(" "), x["rank"]) for x in licenses.rules() if x["k"] in norm for m in re.finditer(x["p"], norm)}
        assert found == want and (r.rank >= 10_000 or any(k == r.rank for _, _, k in found))
        kept = {(d.start, -d.neg_end, d.rank) for d in r[names["kept"]]}
        assert kept == {d for d in want if not any(e[0] <= d[0] and e[1] >= d[1] and e[2] < d[2] for e in want)}

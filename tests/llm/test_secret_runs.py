"""Secrets inside longer runs of token characters."""

from docspark.llm import secrets
from tests.llm.test_operators import secret_network

TOKEN = "Zk3Jq9Xw7Lp2Vt8Nc5RbQm4Ty6HdGs1Fa0Ue"


def test_a_run_that_a_rule_touches_is_judged_in_pieces():
    net = secret_network()
    for text in (f"https://discord.com/api/webhooks/123456789012345678/{TOKEN}", f"id 1234567890123456_{TOKEN} end", f"{TOKEN}/0123456789abcdef0123/{TOKEN}"):
        spans = secrets.base_spans(text)
        found = secrets.candidates(text, spans)
        assert "".join(text[a:b] for a, b in found).count(TOKEN) == text.count(TOKEN)
        assert all(b <= s or a >= e for a, b in found for s, _, e in spans)
        rows = [(text[max(0, a - secrets.BEFORE) : a], text[a:b], text[b : b + secrets.AFTER]) for a, b in found if TOKEN in text[a:b]]
        assert min(net.score(rows)) >= net.threshold


def test_the_middle_of_a_long_run_is_read():
    net = secret_network()
    head, tail = "io/files/v2/public/downloads/", "/reports/yearly/summary/index"
    path = head + TOKEN[:20] + tail
    assert net.score([("https://x.", path, " ")])[0] >= net.threshold
    for core in (path, "a" * 43, "a" * 44, "a" * 45, path * 9):
        parts, owner = secrets.windows([("", "x", ""), ("left", core, "right")])
        own = [p for p, i in zip(parts, owner, strict=True) if i == 1]
        assert all(len(p[1]) <= secrets.INSIDE for p in own)
        assert all(any(core[i : i + 20] in p[1] for p in own) for i in range(len(core) - 19))

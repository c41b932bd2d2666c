"""Time on texts made to be slow."""

import time

import pytest
from tideline.llm.secrets import BASE, MORE

HOSTILE = {"jwt": "eyJ", "pem": "-----BEGIN A ", "repository": "ghp_a", "chat": "xoxb-a", "payment": "sk_live_a", "login": "http://aa", "assign": "token  ", "access": "AKIA ", "hex": "0a"}


@pytest.mark.parametrize("rule", [*BASE, *MORE], ids=lambda r: r.kind)
def test_a_rule_is_linear(rule):
    """A megabyte of a rule's own beginnings, and of all others'."""
    pattern = rule.compiled()
    for start in HOSTILE.values():
        text = start * (1_000_000 // len(start))
        began = time.process_time()
        for _ in pattern.finditer(text):
            pass
        assert time.process_time() - began < 1.5, start


def test_tokens_of_a_run_are_found_at_its_start():
    jwt = next(r for r in MORE if r.kind == "jwt").compiled()
    token = "eyJhbGciOiJI.eyJzdWIiOiIx.sig-1"
    assert [m[0] for m in jwt.finditer(f"Bearer {token}, t={token}\n{token}")] == [token] * 3

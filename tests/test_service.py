import json

import pytest

from lodestone import cli
from lodestone.errors import Forbidden
from lodestone.functions.stemming import lexeme, stem
from lodestone.operators.vectors import Deterministic, ProviderError
from lodestone.security import authenticate, parse_keys
from lodestone.sources.providers import Gemini, Guarded, OpenAI


@pytest.mark.parametrize(
    ("word", "want"),
    [
        ("caresses", "caress"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("this", "this"), ("gaps", "gap"), ("agreed", "agre"), ("hopping", "hop"), ("hoping", "hope"),
        ("luxuriated", "luxuri"), ("generously", "generous"), ("communication", "communic"), ("skies", "sky"), ("news", "news"), ("succeed", "succeed"), ("happily", "happili"), ("cry", "cri"),
        ("by", "by"), ("say", "say"), ("relational", "relat"), ("conditional", "condit"), ("rational", "ration"), ("publishing", "publish"), ("published", "publish"), ("troubleshooting", "troubleshoot"),
        ("controlled", "control"), ("consistency", "consist"), ("knightly", "knight"), ("menus", "menus"), ("buttons", "button"), ("sensibilities", "sensibl"), ("adoption", "adopt"), ("roll", "roll"),
    ],
)
def test_stems(word, want):
    assert stem(word) == want


def test_lexemes():
    assert lexeme("the", "english") is None and lexeme("the", None) == "the" and lexeme("buttons", "english") == "button"


def test_keys():
    keys = parse_keys("a:one, b:two:read , c:three:admin")
    assert authenticate("two", keys).tenant == "b" and authenticate("no", keys) is None
    authenticate("one", keys).require("write")
    authenticate("three", keys).require("admin")
    with pytest.raises(Forbidden):
        authenticate("two", keys).require("write")
    for bad in ("a", ":k", "a:k:odd"):
        with pytest.raises(ValueError):
            parse_keys(bad)


def test_hosted_providers():
    answer = json.dumps({"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}).encode()
    assert OpenAI("http://x/", "k", "m", lambda *a: answer).embed(["a", "b"], 1) == [[1.0], [2.0]]
    assert Gemini("http://x", "k", "m", lambda *a: b'{"embeddings":[{"values":[3]}]}').embed(["a"], 1) == [[3.0]]
    with pytest.raises(ProviderError):
        Gemini("http://x", "k", "m", lambda *a: b"<html>").embed(["a"], 1)


class Failing:
    def __init__(self, times):
        self.left, self.calls = times, 0

    def embed(self, texts, dimensions):
        self.calls += 1
        if self.left:
            self.left -= 1
            raise OSError("down")
        return Deterministic().embed(texts, dimensions)


def test_retry_and_circuit():
    inner = Failing(2)
    assert len(Guarded(inner, sleep=lambda s: None).embed(["a"], 8)) == 1 and inner.calls == 3
    at = [0.0]
    dead = Guarded(Failing(10**6), clock=lambda: at[0], sleep=lambda s: None)
    for _ in range(4):
        with pytest.raises(ProviderError):
            dead.embed(["a"], 8)
    calls = dead.inner.calls
    with pytest.raises(ProviderError, match="open"):
        dead.embed(["a"], 8)
    assert dead.inner.calls == calls
    dead.inner.left, at[0] = 0, 31.0
    assert dead.embed(["a"], 8)


def test_command_line(spark, tmp_path, capsys):
    folder = tmp_path / "docs" / "en"
    folder.mkdir(parents=True)
    (folder / "menu.md").write_text("# Publishing\n\nPress the publish button.")
    (tmp_path / "golden.json").write_text(json.dumps({"collection": "c", "locale": "en", "mode": "lexical", "cases": [{"query": "publish button", "expect": ["menu"], "maxRank": 1}]}))
    root = f"file://{tmp_path}/root"
    assert cli.main(["seed", f"file://{tmp_path}/docs", "--root", root, "--collection", "c", "--tenant", "t"]) == 0
    assert cli.main(["eval", f"file://{tmp_path}/golden.json", "--root", root, "--tenant", "t"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["recall_at_1"] == 1.0

import hashlib
import math
import random
from collections import defaultdict

import pytest

from tablewright.llm.mixing import Mixture, mix_sources
from tablewright.llm.token_counts import CACHE, TokenizerFile, count_tokens

public_tokenizers = pytest.importorskip("public_tokenizers")


def exponent(tokens, mixture):
    """By plain bisection."""
    total = sum(tokens)
    shares = [t / total for t in tokens if t]

    def weights(a):
        z = sum(p**a for p in shares)
        return [p**a / z for p in shares]

    def bisect(fits):
        low, high = 0.0, 1.0
        if fits(1.0):
            return 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if fits(mid) else (low, mid)
        return low

    target = mixture.entropy * math.log(len(shares))
    by_entropy = bisect(lambda a: -sum(w * math.log(w) for w in weights(a)) >= target)
    too_often = bisect(lambda a: max(w / p for w, p in zip(weights(a), shares, strict=True)) * mixture.budget > mixture.most_passes)
    return max(by_entropy, too_often if too_often > 1e-9 else 0.0)


@pytest.mark.parametrize("mixture", [Mixture(entropy=0.9), Mixture(entropy=1.0, most_passes=2.5), Mixture(entropy=0.5, budget=0.5), Mixture(entropy=0.95, budget=2.0)])
def test_sources_get_their_budgets_in_whole_passes_and_one_prefix(documents, mixture):
    r = random.Random(9)
    rows = [(i, "w " * r.randrange(1, 30), "en", r.choices(["a", "b", "c", None], [70, 20, 8, 2])[0]) for i in range(800)]
    found = mix_sources(documents(rows), mixture).collect()
    tokens = defaultdict(int)
    by_source = defaultdict(list)
    for doc, text, _, source in rows:
        tokens[source] += len(text.split())
        by_source[source].append((hashlib.md5(f"{mixture.seed}:{doc}".encode()).hexdigest(), doc, len(text.split())))
    a = exponent(list(tokens.values()), mixture)
    z = sum(t**a for t in tokens.values())
    want = {}
    for source, members in by_source.items():
        budget = tokens[source] ** a / z * sum(tokens.values()) * mixture.budget
        passes, rest = divmod(int(budget), tokens[source])
        upto = 0
        for _, doc, n in sorted(members):
            upto += n
            want[doc] = passes + (upto <= rest)
    got = defaultdict(int)
    for x in found:
        got[x["doc_id"]] += 1
    different = [d for d, n in want.items() if got[d] != n]
    assert len(different) <= 4  # a document at a cut, where the exponent's last digits decide
    assert {(x["doc_id"], x["copy"]) for x in found} == {(d, c) for d, n in got.items() for c in range(n)}


def test_mixing_of_nulls_empty_texts_repeated_rows_and_no_rows(documents):
    rows = [(1, None, "en", None), (2, "", "en", "a"), (None, "x y", "en", "a"), (3, "x", "en", "a"), (3, "x", "en", "a")]
    out = mix_sources(documents(rows))
    assert "score" in out.columns and out.count() >= 4
    assert mix_sources(documents([])).count() == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"])
def test_counts_are_the_library_s_and_the_cache_is_used(spark, documents, tmp_path, name):
    tokenizer = TokenizerFile.read(public_tokenizers.path(name), public_tokenizers.PATTERN if name.endswith("tiktoken") else None)
    texts = ["Hello  world", "Hello  world", "", None, "<s> <|endoftext|> </s>", "ümläut\n\t中文 🙂", "a" * 50_000, " lead"]
    docs = documents([*enumerate(texts), (None, "Hello  world"), (0, "Hello  world")])
    cache = str(tmp_path / "cache")
    found = count_tokens(docs, tokenizer, cache, limit=5).collect()
    count = tokenizer.counter()
    assert len(found) == 10
    for r in found:
        text = (texts[r["doc_id"]] if r["doc_id"] is not None else texts[0]) or ""
        n = count([text])[0]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 5)
    stored = spark.read.schema(CACHE).parquet(cache)
    assert stored.count() == len({t or "" for t in texts})
    count_tokens(documents([(1, "Hello  world"), (2, "new")]), tokenizer, cache).collect()
    assert spark.read.schema(CACHE).parquet(cache).count() == len({t or "" for t in texts}) + 1
    assert count_tokens(documents([]), tokenizer, str(tmp_path / "none")).count() == 0


def test_special_strings_and_versions():
    a = TokenizerFile("model", b"x")
    assert a.version != TokenizerFile("json", b"x").version != TokenizerFile("json", b"y").version


def test_a_source_without_ids_gets_its_budget(documents):
    rows = [(i, f"w{i} " * 9, "en", "big") for i in range(400)] + [(None, f"t{i} " * 8, "en", "nameless") for i in range(50)]
    found = mix_sources(documents(rows), Mixture(entropy=0.5, budget=0.9)).collect()
    tokens = sum(r["n_tokens"] for r in found if r["source"] == "nameless")
    total = {"big": 3600, "nameless": 400}
    a = exponent(list(total.values()), Mixture(entropy=0.5, budget=0.9))
    budget = 400**a / (400**a + 3600**a) * 4000 * 0.9
    assert budget - 8 < tokens <= budget

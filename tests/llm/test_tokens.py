import random

from pyspark.sql import functions as F

from tuneframe.llm import tokens


def test_edits_match_encoding_anew():
    encoder = tokens.encoder_for()
    rng = random.Random(1)
    letters = [*"ab  \n\n\t'stE1.,é", "'s", " "]
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(900)))
        tree = tokens.TokenTree(*encoder.leaves(text))
        for _ in range(6):
            new = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 30, 600])))
            text, tree, _ = tokens.edit(text, tree, rng.randrange(len(text) + 3), rng.choice([0, 0, 1, 5, 50, 400]), new, encoder)
            assert tree.tokens == len(encoder.encoding.encode_ordinary(text)) and tree.chars == len(text)


def test_small_edit_of_a_long_text_encodes_little():
    encoder = tokens.encoder_for()
    text = "some words and then some more of them " * 5000
    tree = tokens.TokenTree(*encoder.leaves(text))
    new, tree, encoded = tokens.edit(text, tree, 100_000, 3, "other", encoder)
    assert encoded < 2000 and tree.tokens == len(encoder.encoding.encode_ordinary(new))


def test_odd_rows(odd, empty, clashing):
    got = tokens.apply_edits(tokens.count_tokens(tokens.sample_edits(odd))).collect()
    encoder = tokens.encoder_for()
    assert len(got) == 10 and all(r["n_tokens"] == len(encoder.encoding.encode_ordinary(r["text"])) == sum(r["leaf_tokens"]) for r in got)
    assert tokens.apply_edits(tokens.count_tokens(tokens.sample_edits(empty))).count() == 0
    assert tokens.count_tokens(clashing).columns.count("n_tokens") == 1
    edits = "array(cast(null as struct<at:long,remove:long,insert:string>), named_struct('at', cast(null as long), 'remove', 1L, 'insert', 'x'), named_struct('at', 0L, 'remove', cast(null as long), 'insert', 'two'), named_struct('at', 0L, 'remove', 1L, 'insert', cast(null as string)))"
    some = {r["doc_id"]: r["text"] for r in tokens.apply_edits(tokens.count_tokens(odd).withColumn("edits", F.expr(edits))).collect()}
    assert some[1] == "wo" and some[9] == "wox y"
    none = tokens.count_tokens(odd).withColumn("edits", F.lit(None).cast("array<struct<at:long,remove:long,insert:string>>"))
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.apply_edits(none).collect()}[1] == 0

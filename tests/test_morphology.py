from civictopics.operators import morphology as mr
from civictopics.operators.prepare import clean_and_prepare

LEXICON = "token string, lemma string"


def lemmas(spark, words, lexicon, rules, exceptions=None):
    found = mr.lemmas_of(
        spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(lexicon, LEXICON),
        mr.detachment_rules(spark, rules), exceptions and spark.createDataFrame(exceptions, LEXICON),
    )
    return {r.word: (r.lemma, r.found_by) for r in found.collect()}


def test_order_of_exceptions_lexicon_and_rules(spark):
    lexicon = [("cidades", "cidade"), ("hospital", "hospital"), ("cidade", "cidade"), ("papel", "papel"), ("mãe", "mãe"), ("ação", "ação"), ("acao", "acao")]
    rules = [("s", ""), ("ais", "al"), ("éis", "el"), ("ões", "ão"), ("ções", "cao")]
    got = lemmas(spark, ["cidades", "hospitais", "papéis", "ações", "mães", "mães", None, "xyzs", "s", "as", "lápis"], lexicon, rules,
                 [("lápis", "lápis"), ("mães", "mamãe")])
    assert got == {
        "cidades": ("cidade", "lexicon"), "hospitais": ("hospital", "rule"), "papéis": ("papel", "rule"), "ações": ("ação", "rule"),
        "mães": ("mamãe", "exception"), "xyzs": ("xyzs", "none"), "s": ("s", "none"), "as": ("as", "none"), "lápis": ("lápis", "exception"),
    }


def test_longest_ending_then_weight_then_smaller_lemma(spark):
    lexicon = [(w, w) for w in ("walk", "walker", "walke", "bak", "bake")]
    assert lemmas(spark, ["walkers"], lexicon, [("s", ""), ("ers", "")])["walkers"] == ("walk", "rule")
    assert lemmas(spark, ["bakes"], lexicon, [("es", ""), ("es", "e")])["bakes"] == ("bak", "rule")
    assert lemmas(spark, ["bakes"], lexicon, [("es", "e"), ("es", "")])["bakes"] == ("bake", "rule")


def test_rules_are_counted_from_the_lexicon(spark):
    pairs = [("hospitais", "hospital"), ("animais", "animal"), ("canais", "canal"), ("cidades", "cidade"), ("casas", "casa"),
             ("casas", "casa"), ("casa", "casa"), ("melhor", "bom"), ("foi", "ir")]
    got = {tuple(r) for r in mr.induced_rules(spark.createDataFrame(pairs, LEXICON)).collect()}
    assert got == {("is", "l", 3), ("s", "", 2)}


def test_preparing_with_rules(spark):
    docs = spark.createDataFrame([(1, "Jornais locais"), (2, "jornal"), (3, None)], "row_id long, proposal_text string")
    lexicon = spark.createDataFrame([("canais", "canal"), ("sinais", "sinal"), ("jornal", "jornal")], LEXICON)
    rules = mr.induced_rules(lexicon)
    got = {r.row_id: r.tokens for r in clean_and_prepare(docs, words=[], lexicon=lexicon, rules=rules).collect()}
    assert got == {1: ["jornal", "locais"], 2: ["jornal"]}

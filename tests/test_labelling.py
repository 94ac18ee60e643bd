from pyspark.sql import functions as F

from civictopics.functions.text import CLEAN_LIMIT, PROMPT_LIMIT
from civictopics.operators import labelling as la
from civictopics.sources import taxonomy as ta


def test_validate_response(spark):
    options = F.array(*[F.lit(o) for o in ("Abastecimento", "Administração", "Saúde")])
    answers = ["", "saúde", "Saúde.", "a", "xyz", "Saúde", None]
    df = spark.createDataFrame(list(enumerate(answers)), "i int, r string")
    got = df.orderBy("i").select(la.validate_response(F.col("r"), options).alias("x")).collect()
    assert [r.x for r in got] == ["Abastecimento", "Saúde", None, "Abastecimento", None, "Saúde", None]


def test_taxonomy_table(spark):
    tax = ta.taxonomy(spark)
    assert tax.select("n1").distinct().count() == 26
    assert tax.filter("n2 is not null").count() == 94
    assert sorted(r.n1 for r in tax.filter("n2 is null").collect()) == [
        "Abastecimento", "Infraestrutura e Fomento", "Planejamento e Gestão"
    ]
    twice = tax.filter("n2 = 'Defesa Civil'").count()
    assert twice == 2


def test_seed_tables(spark):
    tax = ta.taxonomy(spark)
    assert ta.seed_table(tax, 2).groupBy("seed_topic").count().agg(F.max("count")).first()[0] == 3
    assert ta.seed_table(tax).count() == 26 + 94
    assert ta.seed_table(tax).filter("seed <> lower(seed)").count() == 0


def propose(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "row_id long, proposal_text string")


def test_two_levels_by_overlap(spark):
    df = propose(
        spark, "mais policiamento e segurança nas ruas, ordem pública", "abastecimento de alimentos",
        "nada a ver", None, "saúde: medicamentos e aparelhos",
    )
    got = {r.row_id: (r.n1, r.n2) for r in la.classify(df, ta.taxonomy(spark)).collect()}
    assert got == {
        0: ("Segurança e Ordem Pública", "Policiamento"),
        1: ("Abastecimento", la.NO_CHILDREN),
        2: (None, None),
        3: (None, None),
        4: ("Saúde", "Medicamentos e aparelhos"),
    }


def test_two_levels_by_a_model(spark):
    def answer(prompt):
        if "falha" in prompt:
            raise RuntimeError("sem resposta")
        if "Abastecimento" in prompt:
            return " cultura " if "teatro" in prompt else "Saúde"
        return "Difusão Cultural" if "teatro" in prompt else "Atendimento"

    df = propose(spark, "teatro", "posto", "falha")
    got = {
        r.row_id: (r.n1, r.n2, r.response_1, r.error)
        for r in la.classify(df, ta.taxonomy(spark), la.model_responses(answer)).collect()
    }
    assert got == {
        0: ("Cultura", "Difusão Cultural", "cultura", None),
        1: ("Saúde", "Atendimento básico", "Saúde", None),
        2: (None, None, None, "sem resposta"),
    }


def test_labels_reach_all_rows_and_are_counted(spark):
    df = propose(spark, "energia elétrica", "zzz")
    labels = la.classify(df, ta.taxonomy(spark), keep=["proposal_text"])
    assert "proposal_text" in labels.columns
    attached = la.attach_labels(df, labels).orderBy("row_id").collect()
    assert [(r.VCGE_N1, r.VCGE_N2) for r in attached] == [("Energia", "Energia elétrica"), (None, None)]
    audit = {r.n1: (r.cnt, r.answered, r.validated) for r in la.label_distribution(labels).collect()}
    assert audit == {"Energia": (1, 1, 1), None: (1, 0, 0)}


def test_prompt_limits(spark):
    df = propose(spark, "ü" * 5000)
    options = F.array(F.lit("A"), F.lit("B"))
    whole = df.select(la.build_prompt(F.col("proposal_text"), options).alias("p")).first().p
    short = df.select(la.build_prompt(F.col("proposal_text"), options, PROMPT_LIMIT).alias("p")).first().p
    assert whole.count("ü") == 5000 and short.count("ü") == PROMPT_LIMIT
    assert "A, B." in short and "ü..." in short
    assert CLEAN_LIMIT == 2000


def test_no_text_is_shuffled(spark):
    df = propose(spark, "energia")
    labelled = la.classify(df, ta.taxonomy(spark))
    plan = labelled._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert "BroadcastHashJoin" in main and "SortMergeJoin" not in main

"""The two-level subject taxonomy and the seed groups built from it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The government vocabulary, each first-level subject with its second-level subjects,
# both in official order.
SUBJECTS = {
    "Abastecimento": [],
    "Administração": [
        "Cadastro",
        "Compras governamentais",
        "Fiscalização do Estado",
        "Normas e Fiscalização",
        "Operações de dívida pública",
        "Orçamento",
        "Patrimônio",
        "Recursos humanos",
        "Serviços Públicos",
        "Outros em Administração",
    ],
    "Agropecuária, Pesca e Extrativismo": [
        "Defesa e vigilância sanitária",
        "Produção agropecuária",
        "Outros em Agropecuária",
    ],
    "Comércio e Serviços": [
        "Comercio externo",
        "Defesa do Consumidor",
        "Turismo",
        "Outros em Comércio e serviços",
    ],
    "Comunicações": [
        "Comunicações Postais",
        "Telecomunicações",
        "Outros em Comunicações",
    ],
    "Cultura": [
        "Difusão Cultural",
        "Patrimônio Cultural",
        "Outros em Cultura",
    ],
    "Defesa Nacional": [
        "Defesa Civil",
        "Defesa Militar",
        "Outros em Defesa Nacional",
    ],
    "Economia e Finanças": [
        "Defesa da concorrência",
        "Politica econômica",
        "Sistema Financeiro",
        "Outros em Economia e Finanças",
    ],
    "Educação": [
        "Educação básica",
        "Educação profissionalizante",
        "Educação superior",
        "Outros em Educação",
    ],
    "Energia": [
        "Combustíveis",
        "Energia elétrica",
        "Outros em Energia",
    ],
    "Esporte e Lazer": [
        "Esporte comunitário",
        "Esporte profissional",
        "Lazer",
        "Outros em Esporte e Lazer",
    ],
    "Habitação": [
        "Habitação Rural",
        "Habitação Urbana",
        "Outros em Habitação",
    ],
    "Indústria": [
        "Mineração",
        "Produção Industrial",
        "Propriedade Industrial",
        "Outros em Industria",
    ],
    "Infraestrutura e Fomento": [],
    "Meio ambiente": [
        "Água",
        "Biodiversidade",
        "Clima",
        "Preservação e Conservação Ambiental",
        "Outros em Meio Ambiente",
    ],
    "Pesquisa e Desenvolvimento": [
        "Difusão",
        "Outros em Pesquisa e Desenvolvimento",
    ],
    "Planejamento e Gestão": [],
    "Previdência Social": [
        "Combate a pobreza",
        "Previdência Básica",
        "Previdência Complementar",
        "Benefícios Sociais",
        "Outros em Previdência",
    ],
    "Proteção Social": [
        "Assistência à Criança e ao Adolescente",
        "Assistência ao Idoso",
        "Assistência ao Portador de Deficiência",
        "Cidadania",
        "Combate a desigualdade",
        "Outros em Proteção Social",
    ],
    "Relações Internacionais": [
        "Cooperação Internacional",
        "Relações Diplomáticas",
        "Outros em Relações Internacionais",
    ],
    "Saneamento": [
        "Saneamento Básico Rural",
        "Saneamento Básico Urbano",
        "Outros em Saneamento",
    ],
    "Saúde": [
        "Assistência Hospitalar e Ambulatorial",
        "Atendimento básico",
        "Combate a epidemias",
        "Defesa e vigilância sanitária",
        "Medicamentos e aparelhos",
        "Outros em Saúde",
    ],
    "Segurança e Ordem Pública": [
        "Defesa Civil",
        "Policiamento",
        "Outros em Segurança e Ordem Pública",
    ],
    "Trabalho": [
        "Empregabilidade",
        "Fomento ao Trabalho",
        "Proteção e Benefícios ao Trabalhador",
        "Relações de Trabalho",
        "Outros em Trabalho",
    ],
    "Transportes": [
        "Transporte Aéreo",
        "Transporte Ferroviário",
        "Transporte Hidroviário",
        "Transporte Rodoviário",
        "Outros em Transporte",
    ],
    "Urbanismo": [
        "Infraestrutura Urbana",
        "Serviços Urbanos",
        "Outros em Urbanismo",
    ],
}

SCHEMA = T.StructType([
    T.StructField("n1_pos", T.IntegerType(), False),
    T.StructField("n1", T.StringType(), False),
    T.StructField("n2_pos", T.IntegerType(), True),
    T.StructField("n2", T.StringType(), True),
])


def subjects() -> dict[str, list[str]]:
    """First-level subject -> second-level subjects, both in official order."""
    return {n1: list(children) for n1, children in SUBJECTS.items()}


def taxonomy(
    spark: SparkSession, entries: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """``(n1_pos, n1, n2_pos, n2)``, one row per second-level subject.

    A first-level subject without children has one row with null ``n2``.  Names repeat across
    parents, so ``(n1, n2)`` is the key.  ``entries`` replaces the built-in subjects; a taxonomy
    kept as a table needs only these four columns.
    """
    rows = []
    for n1_pos, (n1, children) in enumerate((subjects() if entries is None else entries).items()):
        rows.extend((n1_pos, n1, n2_pos, n2) for n2_pos, n2 in enumerate(children))
        if not children:
            rows.append((n1_pos, n1, None, None))
    return spark.createDataFrame(rows, SCHEMA)


def seed_table(tax: DataFrame, max_children: int | None = None) -> DataFrame:
    """``(seed_topic, seed)``: lower-cased subject names, each with its children.

    ``max_children=2`` gives the groups used to strengthen words, ``None`` the full groups used to
    guide topics.
    """
    parents = tax.select("n1_pos", F.lit(-1).alias("pos"), F.col("n1").alias("seed")).distinct()
    children = tax.filter(F.col("n2").isNotNull())
    if max_children is not None:
        children = children.filter(F.col("n2_pos") < max_children)
    return parents.unionByName(
        children.select("n1_pos", F.col("n2_pos").alias("pos"), F.col("n2").alias("seed"))
    ).select(F.col("n1_pos").alias("seed_topic"), "pos", F.lower("seed").alias("seed"))


def seed_texts(seeds: DataFrame) -> DataFrame:
    """``(row_id, clean_text)``: the phrases of each seed topic joined to one short text."""
    placed = F.sort_array(F.collect_list(F.struct("pos", "seed")))
    return (
        seeds.groupBy(F.col("seed_topic").cast("long").alias("row_id"))
        .agg(placed.alias("placed"))
        .select("row_id", F.array_join("placed.seed", " ").alias("clean_text"))
    )

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import columns as C
from quillgraph.functions import udfs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [("  Hello, (World)!  ", ["hello", "world"]), ("", []), (None, []), ("!!! ...", []), ("a-b it's", ["a-b", "it's"])],
)
def test_search_tokens(spark, text, tokens):
    assert one(spark, C.search_tokens(F.lit(text))) == tokens


@pytest.mark.parametrize(("text", "terms"), [("Who wrote the Ring?", ["wrote", "ring"]), ("plain words", None), ("is it?", None), (None, None), ("where x", None)])
def test_question_terms(spark, text, terms):
    assert one(spark, C.question_terms(F.lit(text))) == terms


@pytest.mark.parametrize(("raw", "label"), [(" Has  Phase ", "has_phase"), ("écrit", ""), ("9lives", ""), (None, ""), ("a--b", "a_b"), ("x" * 81, "")])
def test_predicate_label(spark, raw, label):
    assert one(spark, C.predicate_label(F.lit(raw))) == label


def test_quality_weight(spark):
    weights = [one(spark, C.quality_weight(F.lit(p), F.lit(t))) for p, t in (("Tag", "x y"), (None, "v2.3"), (None, "NX"), (None, ""), (None, "version of"), ("says", "tagged"))]
    assert weights == [0.15, 0.3, 1.0, 0.3, 0.15, 1.0]


def test_cosine_modes(spark):
    a, b = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.array(F.lit(1.0), F.lit(2.0))
    assert one(spark, C.cosine(a, b)) == pytest.approx(1.0)
    assert one(spark, C.cosine(a, b, "strict")) == 0.0
    assert one(spark, C.cosine(a, b, "full")) == pytest.approx(5 / (14**0.5 * 5**0.5))
    assert one(spark, C.cosine(a, F.array().cast("array<double>"))) == 0.0


def test_names(spark):
    lit = F.lit
    assert one(spark, C.surname(lit("Casey Lee"))) == "lee"
    assert one(spark, C.surname(lit("Sprint 01"))) is None
    assert one(spark, C.email_handle(lit("casey.lee@x.org"))) == "casey lee"
    assert one(spark, C.email_handle(lit("casey"))) is None
    assert one(spark, C.token_subset(lit("Casey"), lit("Casey Lee")))
    assert not one(spark, C.token_subset(lit("Lee"), lit("Casey Lee")))
    assert one(spark, C.token_subset_unordered(lit("Casey Lee"), lit("Dr Casey Lee")))
    assert not one(spark, C.token_subset_unordered(lit("Lab"), lit("Morgan Lab")))
    assert one(spark, C.alias_base(lit("Acme Press Ltd"))) == ["acme"]
    assert one(spark, C.alias_base(lit("Press"))) == ["press"]


@pytest.mark.parametrize(
    ("scheme", "value", "ok"),
    [("QID", "Q42", True), ("QID", "Q0", False), ("ORCID", "0000-0002-1825-0097", True), ("ORCID", "0000-0002-1825-0098", False), ("DOI", "10.1000/182", True), ("ISBN", "0-306-40615-2", True), ("ISBN", "978-0-306-40615-7", True), ("ISBN", "978-0-306-40615-8", False), ("EMAIL", "a@b.org", True), ("EMAIL", "a@b", False), ("DOMAIN", "a.example.org", True), ("DOMAIN", "-a.org", False), ("NONE", "x", False), ("ISBN", None, False)],
)
def test_identifiers(spark, scheme, value, ok):
    assert one(spark, C.valid_identifier(F.lit(scheme), F.lit(value))) is ok


def test_dates(spark):
    found = [one(spark, C.parsed_date(F.lit(x))) for x in ("2026-01-02", "2026-01-02T03:04:05Z", "soon", None)]
    assert [str(x) for x in found] == ["2026-01-02", "2026-01-02", "None", "None"]


def test_unicode_keys():
    assert udfs.exact_key("  Straße\tX ") == "strasse x"
    assert udfs.discovery_key("São_Paulo’s") == "sao paulo's"
    assert udfs.jaro("riley", "ridley") == pytest.approx(0.9444444)
    assert udfs.jaro_winkler_of("riley", "ridley") == pytest.approx(0.9611111, abs=0.01)
    assert udfs.jaro("", "") == 1.0 and udfs.jaro("a", "") == 0.0 and udfs.jaro("ab", "cd") == 0.0


def test_udfs_run(spark):
    row = spark.createDataFrame([("Ä b", "uses_tool", "use_tools")], "t string, a string, b string").select(
        udfs.exact_surface_key("t"), udfs.discovery_surface_key("t"), udfs.string_affinity("a", "b"), udfs.stub_embedding("t")
    )
    key, found, ratio, vector = row.first()
    assert (key, found) == ("ä b", "a b") and 0.8 < ratio < 1 and sum(v * v for v in vector) == pytest.approx(1)

import tracemalloc

import pyarrow as pa
import pytest

from threadmine.functions import stem
from threadmine.functions.porter2 import stem_word
from threadmine.functions.stem import stem_dictionary, stem_term, stem_words

# Sample vocabulary of the published algorithm, and words for its special cases.
SAMPLES = """
consign consign consigned consign consignment consign consistency consist consistently consist
consolation consol consolatory consolatori consolidate consolid consolingly consol consonant
conson conspicuously conspicu conspiracy conspiraci conspirator conspir constable constabl
constancy constanc knack knack knackeries knackeri knavish knavish kneaded knead kneel kneel
knees knee knew knew knif knif knightly knight knitted knit knitting knit knives knive knocker
knocker knopp knopp apache apach solution solut utils util generously generous communication
communic university univers happy happi hopping hop hoping hope luxuriated luxuri rolling roll
controlling control agreed agre feed feed by by say say playing play enjoying enjoy sized size
tied tie cries cri gas gas this this gaps gap kiwis kiwi caresses caress herrings herring
exceeds exceed analogy analog formative format electrical electr hopeful hope adoption adopt
possibly possibl organization organ relational relat conditional condit bed bed yellow yellow
syzygy syzygi skies sky dying die news news only onli using use a a is is
""".split()


@pytest.mark.parametrize("word, stem", list(zip(SAMPLES[::2], SAMPLES[1::2])))
def test_published_samples(word, stem):
    assert stem_word(word) == stem


def test_arrays_keep_their_shape(spark):
    rows = [(1, ["running", "dogs"]), (2, []), (3, None), (4, ["dogs", None, "running"])]
    df = spark.createDataFrame(rows, "id INT, w ARRAY<STRING>").coalesce(1)
    got = {r.id: r.s for r in df.select("id", stem_words("w").alias("s")).collect()}
    assert got == {1: ["run", "dog"], 2: [], 3: None, 4: ["dog", None, "run"]}


def test_filtered_and_repeated_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(100).selectExpr("id", "array('cats', concat('word', id % 3)) AS w")
        got = df.filter("id % 2 = 1").select("id", stem_words("w").alias("s")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 50
    assert all(r.s == ["cat", f"word{r.id % 3}"] for r in got)


def test_terms_and_dictionary(spark):
    df = spark.createDataFrame([(["cats", "cats", "flies"],), (["flies"],)], "w ARRAY<STRING>")
    assert {tuple(r) for r in stem_dictionary(df, "w").collect()} == {
        ("cats", "cat"), ("flies", "fli"),
    }
    terms = spark.createDataFrame([("flies",), (None,)], "t STRING")
    assert [r[0] for r in terms.select(stem_term("t")).collect()] == ["fli", None]


def test_remembered_words_take_little_memory():
    """Before, a remembered word was two Python strings and an entry of a dictionary."""
    words = [f"b{i}dances" for i in range(50_000)]
    some = pa.array([words, ["cats"]], pa.list_(pa.string()))
    held = pa.total_allocated_bytes()
    tracemalloc.start()
    try:
        made = stem._stem_array.func(iter([some.slice(0, 1), some]))
        assert next(made).to_pylist() == [[stem_word(w) for w in words]]
        taken = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - held
    finally:
        tracemalloc.stop()
    assert taken < 80 * len(words)
    assert next(made).to_pylist() == [[stem_word(w) for w in words], ["cat"]]


def test_words_are_remembered_and_forgotten(monkeypatch):
    monkeypatch.setattr(stem, "MEMO_WORDS", 3)
    asked = []
    monkeypatch.setattr(stem, "stem_word", lambda w: asked.append(w) or w[:-1])
    memo = stem._Memo()
    for words in (["as", "bs"], ["bs", "cs", "as"], ["ds"], ["as", "ds"]):
        assert memo.stems_of(pa.array(words)).to_pylist() == [w[0] for w in words]
    assert asked == ["as", "bs", "cs", "ds", "as", "ds"] and len(memo) == 2
    assert memo.stems_of(pa.array([], pa.string())).to_pylist() == []


def test_long_words_are_forgotten_sooner(monkeypatch):
    monkeypatch.setattr(stem, "MEMO_BYTES", 1000)
    memo = stem._Memo()
    for i in range(50):
        words = [f"{i}{'x' * 300}ing", "cats"]
        assert memo.stems_of(pa.array(words)).to_pylist() == [stem_word(w) for w in words]
        assert memo.words.nbytes < 2000


def test_large_arrow_strings():
    lists = pa.array([["cats", None, "flies"], None, []], pa.list_(pa.large_string()))
    made = list(stem._stem_array.func(iter([lists])))
    assert pa.concat_arrays(made).to_pylist() == [["cat", None, "fli"], None, []]

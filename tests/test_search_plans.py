"""Plans of file search stay small."""

from graphloom.functions.text import FILE_STOP_WORDS
from graphloom.operators import ranking as K
from graphloom.operators.tables import file_endpoints, search_files, search_symbols


def test_a_file_score_says_each_thing_once(spark):
    """A question of four words: what the score asks several times is a column, not an expression repeated in the plan."""
    sf = "/root/testdata/sf0.001"
    q = K.asked("how does the red bolt cache work", FILE_STOP_WORDS)
    found = K.ranked_files(search_files(spark, sf), search_symbols(spark, sf), file_endpoints(spark, sf), q)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 200_000

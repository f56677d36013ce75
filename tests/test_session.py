from thermocline.plans.catalog import QUERIES
from thermocline.session import HUGE_METHOD, SETTINGS


def test_queries_bring_the_method_limit_to_a_foreign_session(spark, folder):
    """With the engine's own limit, fused stages of text columns run interpreted; a limit set by someone stays."""
    other = spark.newSession()
    for given, wanted in (("65535", SETTINGS[HUGE_METHOD]), ("20000", "20000")):
        other.conf.set(HUGE_METHOD, given)
        assert QUERIES["format_columns"](other, folder).count() > 0
        assert other.conf.get(HUGE_METHOD) == wanted

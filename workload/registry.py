"""Named queries, each with its SQL twin where SQL can say it."""

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def register(function):
        def run(spark, sf_dir):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register

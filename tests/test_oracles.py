"""Every query with an oracle gives the oracle's rows; the rest give rows."""

import pytest
from oracle import differences, expected

from seqloom.plans import catalog

#: Heavy chains of iterations; the graph tests cover them on small inputs.
SLOW = {"t12_transcripts", "gap7_rendered", "gap7_agp", "g4_unitigs", "g3_tips", "g6_bubbles", "snk5_contigs", "snk7_contig_arcs", "g6_pinched", "t1_expression", "t1_transcripts"}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SLOW))
def test_query(spark, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name in catalog.ORACLE_SQL:
        assert not differences(got, expected(sf_dir, catalog.ORACLE_SQL[name]))
    else:
        assert len(got)

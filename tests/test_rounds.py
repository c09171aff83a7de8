"""Registered queries run the operators' default rounds."""
from lamella.plans import catalog


def test_default_rounds(spark, sf):
    assert catalog.QUERIES["permutation_test"](spark, sf).count() == 21  # the observed labels and 20 shuffles
    assert catalog.QUERIES["mccv"](spark, sf).count() == 5  # sizes 2, 3, 5, 10, 20

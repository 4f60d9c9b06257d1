"""All registered queries, one module per area; importing this package
fills ``sendero.plans.registry.QUERIES`` and ``ORACLE``."""

from sendero.plans.registered import answers, collections, evaluation, inputs, retrieval  # noqa: F401

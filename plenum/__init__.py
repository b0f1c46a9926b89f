"""plenum: a Spark-native engine for open-text public feedback.

Relational operators live in ``operators``, scalar functions in ``functions``,
readers in ``sources``, report builders in ``plans`` and continuous variants in
``streaming``.  The optional ``llm`` subpackage holds training-data operators;
nothing outside it imports it.
"""

__version__ = "0.1.0"

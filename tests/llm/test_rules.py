"""Every match of a license rule holds the rule's keyword as a word, so that the keyword gate loses nothing."""

import itertools
import re
from re import _constants as sre
from re import _parser as parser

from birthwave.llm.licence_rules import signatures


def variants(tree):
    """Texts that a pattern matches: every alternative, optional parts with and without, one repeat of the rest."""
    parts = []
    for op, arg in tree:
        if op is sre.LITERAL:
            parts.append([chr(arg)])
        elif op is sre.IN:
            parts.append([chr(v) if o is sre.LITERAL else "7" for o, v in arg if o in (sre.LITERAL, sre.CATEGORY, sre.RANGE)])
        elif op is sre.BRANCH:
            parts.append([v for branch in arg[1] for v in variants(branch)])
        elif op is sre.SUBPATTERN:
            parts.append(variants(arg[3]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, _, inner = arg
            parts.append(([""] if low == 0 else []) + [v * max(1, low) for v in variants(inner)])
        elif op is sre.ANY or op is sre.CATEGORY:
            parts.append(["x"])
        elif op is not sre.AT:
            raise AssertionError(f"unexpected {op}")
    return ["".join(p) for p in itertools.islice(itertools.product(*parts), 20_000)]


def test_every_match_holds_the_keyword():
    rules = signatures()
    assert len(rules) > 200
    for rule in rules:
        for text in variants(parser.parse(rule.pattern)):
            if re.fullmatch(rule.pattern, text):
                assert rule.keyword in text.split(), (rule.label, rule.pattern, text)


def test_freebsd_licence_alone(spark):
    from birthwave.llm import licences

    rows = spark.createDataFrame([(1, "Released under the FreeBSD License.")], "doc_id long, text string")
    assert licences.scan(rows).first()["labels"] == "bsd-2-clause"

"""Wording of questions: paraphrase frames and the words that carry no table name.

Slots: {m} measure, {g} group, {gp} group plural, {d} entity plural, {c} columns,
{l} measure label, {n} how many, {v} threshold, {x} dimension plural, {y} fact
entity, {p} ', separately for every <part>', {f} filters.
"""

from __future__ import annotations

FRAMES = {
    "list": ("{d}: their {c}{f}", "I need the {c} of our {d}{f}", "pull {c} for these {d}{f}",
             "could you print {c} of the {d}{f}?"),
    "agg": ("{m} split by {g}{f}", "for every {g}, what {m} do we see{f}?", "I want {m}, one line per {g}{f}",
            "please compare {m} between the {gp}{f}"),
    "agg_global": ("{m} altogether{f}", "how big is the {m}{f}?", "report one figure: {m}{f}"),
    "having": ("{gp} that pass {v} in {m}{f}", "do any {gp} go beyond {v} for {m}{f}?",
               "keep the {gp} with {m} past {v}{f}"),
    "top_n": ("the leading {n} {gp} measured on {m}{f}", "{n} strongest {gp} judging by {m}{f}",
              "who are our first {n} {gp} when sorted on {m}{f}?"),
    "above_avg": ("{d} beating the usual {l}", "do some {d} carry a {l} beyond the typical one?",
                  "{d} with an unusually big {l}"),
    "semijoin": ("{x} seen in some {y}{f}", "do we know {x} that occur with a {y}{f}?",
                 "{x} for whom a {y} exists{f}"),
    "window": ("put the {d} in sequence on their {l}{p}", "{d} numbered from big to small {l}{p}",
               "what position does each of the {d} take on {l}{p}?"),
}
MEASURE_VARIANTS = {
    "SUM": ("combined {l}", "{l} added up"),
    "AVG": ("typical {l}", "{l} on average"),
    "MAX": ("biggest {l}", "{l} at its peak"),
    "MIN": ("least {l}", "{l} at its lowest"),
    "COUNT": ("how many {d}", "{d} counted"),
}
YEAR_VARIANTS = (" in {v}", " dated {v}", " of the year {v}")
MEASURE_WORDS = {"SUM": "total", "AVG": "average", "MAX": "largest", "MIN": "smallest"}
# -- fixed values: words that say nothing about which table a question needs -------------
# grammar
FUNCTION_WORDS = ("a an the of by per for each with and or is are to on in at that which what who whose how do does "
                  "from all any our we me i you s").split()
# asking and counting
QUESTION_WORDS = ("show list give get find pull print count number total sum average mean top highest largest smallest "
                  "most least rank than more above below over under have has only where across within").split()
# parts of column labels that most tables share
SHARED_LABEL_WORDS = "id key name code status date year".split()
# -----------------------------------------------------------------------------------------

STOP_WORDS = (*FUNCTION_WORDS, *QUESTION_WORDS, *SHARED_LABEL_WORDS)

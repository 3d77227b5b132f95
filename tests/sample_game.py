"""One hand-made game as an event: okc 106 - por 92."""

import json

# Sample box lines (an ordinary one, one without position, one of
# a player who did not play).
LINES = [
    {"name": "K. Durant", "pos": "F", "min": "42:41", "fgmA": "7-14", "threePmA": "1-3",
     "ftmA": "8-12", "minusSlashPlus": "+13", "offReb": 2, "defReb": 15, "totalReb": 17,
     "ast": 7, "pf": 1, "steels": 0, "to": 6, "bs": 2, "ba": 0, "pts": 23},
    {"name": "N. Collison", "pos": "", "min": "27:38", "fgmA": "5-6", "threePmA": "0-0",
     "ftmA": "2-2", "minusSlashPlus": "+11", "offReb": 0, "defReb": 5, "totalReb": 5,
     "ast": 2, "pf": 5, "steels": 1, "to": 1, "bs": 1, "ba": 0, "pts": 12},
    {"name": "R. Jackson", "pos": "DNP - Coach's Decision", "min": "", "pts": 0},
]

# 3 November 2012, 05:00 in Moscow.
MILLIS = 1351904400000


def event(home="okc", away="por", millis=MILLIS, home_score=106, away_score=92, **changes):
    result = {
        "homeTeam": home, "homeScore": home_score, "awayTeam": away, "awayScore": away_score,
        "time": millis, "homeScoreLine": "26-23-25-32", "awayScoreLine": "21-21-24-26",
        "homeTotal": {"minutes": 240, "fgmA": "39-76", "pts": home_score},
        "awayTotal": {"minutes": 240, "fgmA": "32-89", "pts": away_score},
        "homeScoreBox": LINES, "awayScoreBox": LINES[:1],
    }
    result.update(changes)
    return {"teamName": home, "result": {k: v for k, v in result.items() if v is not None}}


def payload(*args, **changes):
    return json.dumps(event(*args, **changes))

"""The league as configured by default: teams, arenas and stage markers."""

from __future__ import annotations

TIME_ZONE = "America/New_York"

# The 30 teams with their conference.
TEAMS = [
    ("gsw", "west"), ("okc", "west"), ("por", "west"), ("sac", "west"), ("den", "west"),
    ("uta", "west"), ("dal", "west"), ("mem", "west"), ("sas", "west"), ("lal", "west"),
    ("lac", "west"), ("hou", "west"), ("min", "west"), ("phx", "west"), ("nop", "west"),
    ("atl", "east"), ("bos", "east"), ("bkn", "east"), ("was", "east"), ("det", "east"),
    ("ind", "east"), ("cle", "east"), ("mia", "east"), ("mil", "east"), ("nyk", "east"),
    ("tor", "east"), ("phi", "east"), ("chi", "east"), ("cha", "east"), ("orl", "east"),
]

# The home arena of each team.
ARENAS = [
    ("gsw", "ORACLE Arena | Oakland, CA"),
    ("uta", "Vivint Smart Home Arena | Salt Lake City, UT"),
    ("dal", "American Airlines Center | Dallas, TX"),
    ("min", "Target Center | Minneapolis, MN"),
    ("okc", "Chesapeake Energy Arena | Oklahoma City, OK"),
    ("por", "Moda Center | Portland, OR"),
    ("sac", "Sleep Train Arena | Sacramento, CA"),
    ("den", "Pepsi Center | Denver, CO"),
    ("mem", "FedExForum | Memphis, TN"),
    ("sas", "AT&T Center | San Antonio, TX"),
    ("lal", "Staples Center | Los Angeles, CA"),
    ("lac", "Staples Center | Los Angeles, CA"),
    ("hou", "Toyota Center | Houston, TX"),
    ("phx", "Talking Stick Resort Arena | Phoenix, AZ"),
    ("nop", "Smoothie King Center | New Orleans, LA"),
    ("atl", "Philips Arena | Atlanta, GA"),
    ("bos", "TD Garden | Boston, MA"),
    ("bkn", "Barclays Center | Brooklyn, NY"),
    ("was", "Verizon Center | Washington, DC"),
    ("det", "Palace of Auburn Hills | Detroit, MI"),
    ("ind", "Bankers Life Fieldhouse | Indianapolis, IN"),
    ("cle", "Quicken Loans Arena | Cleveland, OH"),
    ("mia", "AmericanAirlines Arena | Miami, FL"),
    ("mil", "BMO Harris Bradley Center | Milwaukee, WI"),
    ("nyk", "Madison Square Garden | New York, NY"),
    ("tor", "Air Canada Centre | Toronto, ON"),
    ("phi", "Wells Fargo Center | Philadelphia, PA"),
    ("chi", "United Center | Chicago, IL"),
    ("cha", "Time Warner Cable Arena | Charlotte, NC"),
    ("orl", "Amway Center | Orlando, FL"),
]

# Each marker opens a stage, the next one closes it; the last
# marker only closes.
STAGE_MARKERS = [
    ("season-12-13", "2012-10-28"), ("playoff-12-13", "2013-04-19"), ("summer-12-13", "2013-06-20"),
    ("season-13-14", "2013-10-27"), ("playoff-13-14", "2014-04-18"), ("summer-13-14", "2014-06-16"),
    ("season-14-15", "2014-10-27"), ("playoff-14-15", "2015-04-16"), ("summer-14-15", "2015-06-20"),
    ("season-15-16", "2015-10-26"), ("playoff-15-16", "2016-04-16"), ("summer-15-16", "2016-06-20"),
    ("season-16-17", "2016-10-25"), ("playoff-16-17", "2017-04-19"), ("summer-16-17", "2017-06-20"),
]

# Labels of the playoff series, in the order the series end.
# The last label carries a trailing blank.
SERIES_LABELS = (
    [f"{n}. First round" for n in range(1, 9)]
    + [f"{n}. Conference semifinal" for n in range(1, 5)]
    + [f"{n}. Conference final" for n in range(1, 3)]
    + ["Final. "]
)

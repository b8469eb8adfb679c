"""Research plans: operators wired over the bridge, one relation after the other."""

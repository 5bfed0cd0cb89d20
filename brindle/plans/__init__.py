"""Plan fragments and snapshot bookkeeping that several operators share."""

"""DataFrame operators: stamps and weights in coadd, dense systems in solvers."""

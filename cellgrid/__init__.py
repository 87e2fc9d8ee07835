"""cellgrid: imaging-cytometry analytics as Spark DataFrame jobs.

Images, label maps, masks and photon-decay stacks are tables keyed by
``(dataset, channel, y, x)``.  Every operator takes and returns DataFrames and
works on all datasets at once, so one call is one distributed job.
"""

__version__ = "0.1.0"

"""Images with known cells."""

import numpy as np


def five_cells():
    image = np.full((100, 100), 10.0)
    labels = np.zeros((100, 100), dtype=int)
    spots = [(10, 30, 10, 30, 100), (10, 30, 60, 80, 200), (50, 70, 10, 30, 150), (50, 70, 60, 80, 250), (70, 85, 35, 50, 175)]
    for i, (y0, y1, x0, x1, v) in enumerate(spots, 1):
        image[y0:y1, x0:x1] = v
        labels[y0:y1, x0:x1] = i
    return image, labels

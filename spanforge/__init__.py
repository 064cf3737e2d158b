"""spanforge: open-world entity typing as DataFrame-to-DataFrame functions."""

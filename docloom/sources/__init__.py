"""Where documents come from: files and their routes, and what is read from them."""
